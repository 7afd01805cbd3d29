"""The formula catalogue: named stages of SQL expressions over bars. BASE comes first for all; each group lists what it emits."""

from __future__ import annotations

from collections.abc import Callable

from ledgerline.functions.exprs import centred_rank, div, frame, lag, roll, shrunk_corr, sorted_rank, stride

EPS = "0.0000000001D"
FIRST = {"lc": lag("close")}
BASE = {
    "r1": f"{div('close', 'lc')} - 1", "gap": div("open - lc", "lc"), "irange": div("high - low", "open"), "iret": div("close - open", "open"),
    "tr": "greatest(high - low, abs(high - lc), abs(low - lc))", "us": div("high - greatest(open, close)", "close"), "ls": div("least(open, close) - low", "close"),
    "cpos": f"case when high > low then {div('close - low', 'high - low')} end", "opos": f"case when high > low then {div('open - low', 'high - low')} end",
    "ord": "cast(row_number() over (partition by code order by date) as double)",
}


def position(n: int, low: str, high: str) -> str:
    return f"(close - min({low}) {frame(n)}) / (max({high}) {frame(n)} - min({low}) {frame(n)} + {EPS})"


#: For Spark, the price position of a year goes by blocks of twelve rows.
YEAR = ([{"lo": f"min(close) {frame(12)}", "hi": f"max(close) {frame(12)}"}, {"lo252": f"min(lo) {stride(252, 12, 'ord')}", "hi252": f"max(hi) {stride(252, 12, 'ord')}"}], f"(close - lo252) / (hi252 - lo252 + {EPS})")


def groups(ranked: Callable[[str], str], year: tuple[list[dict[str, str]], str]) -> dict[str, tuple[list[dict[str, str]], dict[str, str]]]:
    """group: (further stages, emitted columns)."""
    return {
        "momentum": ([], {"return_3d": f"{div('close', lag('close', 3))} - 1", "return_5d": f"{div('close', lag('close', 5))} - 1", "return_20d": f"{div('close', lag('close', 20))} - 1", "reversal_60d": f"-({div('close', lag('close', 60))} - 1)", "gap_pct": "gap", "intraday_range_pct": "irange", "intraday_return": "iret"}),
        "volatility": ([], {"volatility_3d": roll("stddev_samp", "r1", 3), "volatility_20d": roll("stddev_samp", "r1", 20), "volatility_60d": roll("stddev_samp", "r1", 60), "atr_pct": div(roll("avg", "tr", 14), "close"), "bollinger_width": div(f"4 * {roll('stddev_samp', 'close', 20)}", roll("avg", "close", 20)), "downside_vol_20d": roll("stddev_samp", "case when r1 < 0 then r1 end", 20, 5)}),
        "position": (year[0], {"price_position_252d": year[1], "price_position_5d": position(5, "low", "high"), "stochastic_k": position(14, "low", "high"), "close_bias_20d": f"{div('close', roll('avg', 'close', 20))} - 1"}),
        "trend": ([], {"trend_strength": f"case when count(close) {frame(20)} = 20 and max(close) {frame(20)} > min(close) {frame(20)} then regr_r2(close, ord) {frame(20)} end"}),
        "liquidity": ([{"am": f"abs(r1) / (volume + {EPS})"}], {"volume_ratio": div("volume", roll("avg", "volume", 20)), "amihud_illiquidity": "am", "amihud_3d": roll("avg", "am", 3), "avg_amount_3d": roll("avg", "amount", 3), "avg_amount_90d": roll("avg", "amount", 90), "amount_shrink_5_60": div(roll("avg", "amount", 5), roll("avg", "amount", 60)), "amount_conc_20d": div(roll("sum", "amount * amount", 20), f"(sum(amount) {frame(20)} * sum(amount) {frame(20)})")}),
        "turnover": ([{"mv": f"sum(amount) over (partition by code order by date rows between unbounded preceding and current row)"}, {"t1": div(div("amount", "mv"), "10")}, {"t3": roll("avg", "t1", 3)}], {"ln_cap": "case when mv > 0 then ln(mv) end", "turnover_3d": "t3", "turnover_3d_rank": ranked("t3"), "turnover_3d_ratio": div("t3", roll("avg", "t3", 20)), "range_efficiency": f"case when t1 > 0 then {div('irange', 't1')} end"}),
        "shadows": ([], {"upper_shadow": "us", "lower_shadow": "ls", "close_pos": "cpos", "open_pos": "opos", "shadow_ratio": f"case when us + ls > 0 then {div('us', 'us + ls')} end", "close_pos_mean_3d": roll("avg", "cpos", 3), "close_pos_mean_20d": roll("avg", "cpos", 20), "close_pos_std_20d": roll("stddev_samp", "cpos", 20), "open_pos_mean_20d": roll("avg", "opos", 20, 10)}),
        "ranks": ([{"r20": f"{div('close', lag('close', 20))} - 1"}], {"return_1d_rank": ranked("r1"), "return_20d_rank": ranked("r20"), "volume_rank": ranked("volume")}),
        "crowding": ([{"hr": ranked("high"), "vr": ranked("volume"), "sd10": roll("stddev_samp", "high", 10, 10), "hv10": shrunk_corr("high", "volume", 10)}, {"cov5": roll("covar_pop", "hr, vr", 5).replace("count(hr, vr)", "count(hr)")}, {"cov5g": f"case when count(hr) {frame(5)} = 5 then round(cov5, 12) end", "sd10r": "round(sd10, 9)"}], {"high_vol_crowd_5d": f"-({ranked('cov5g')})", "high_vol_heat_10d": f"-({ranked('sd10r')}) * hv10"}),
        "comovement": ([{"mkt": "avg(r1) over (partition by date)"}], {"vol_price_corr_20d": shrunk_corr("volume", "r1", 20), "stock_index_corr_20d": shrunk_corr("r1", "mkt", 20)}),
        "limits": ([{"up": "case when r1 >= 0.095D then 1.0D when r1 is not null then 0.0D end", "dd5": f"{div('close', roll('max', 'high', 5))} - 1"}, {"island": "sum(case when up = 1 then 0 else 1 end) over (partition by code order by date rows between unbounded preceding and current row)"}, {"streak": "cast(sum(coalesce(up, 0.0D)) over (partition by code, island order by date rows between unbounded preceding and current row) as double)"}], {"limit_up_cnt_20d": roll("sum", "up", 20), "limit_up_streak_max_60d": roll("max", "streak", 60), "post_high_drawdown_10d": roll("min", "dd5", 10), "min_5d": roll("min", "r1", 5), "overnight_mean_20d": roll("avg", "gap", 20)}),
        "spikes": ([{"spike": f"case when volume > 2 * {roll('avg', 'volume', 20)} then 1.0D else 0.0D end"}], {"first_volume_spike_5d": f"case when spike = 1 and sum(spike) {frame(5)} <= 1 then 1.0D end"}),
    }


GROUPS, PORTABLE = groups(sorted_rank, YEAR), groups(centred_rank, ([], position(252, "close", "close")))


def stages_of(group: str, portable: bool = False) -> list[dict[str, str]]:
    """For Spark, or in standard SQL."""
    more, emitted = (PORTABLE if portable else GROUPS)[group]
    return [FIRST, BASE, *more, emitted]


def emitted(group: str) -> list[str]:
    return list(GROUPS[group][1])
