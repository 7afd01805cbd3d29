"""What the findings of round 3 were about: shuffles of ranks and formulas, ties, divisions by zero, tolerances that are met exactly."""

import datetime as dt
import os
import re
import subprocess
import sys

import duckdb
import numpy as np
import pytest

from ledgerline.functions.exprs import staged
from ledgerline.operators import alphas, factors, panel
from ledgerline.plans import catalogue, market, upkeep  # noqa: F401 - registers its queries
from ledgerline.sources import bars

DAY = dt.date(2000, 7, 10)
BARS = "code long, date date, open double, high double, low double, close double, volume double, amount double"


@pytest.fixture(scope="module")
def lines(tmp_path_factory):
    """Lines of 120 suppliers on 30 dates; prices repeat."""
    d = str(tmp_path_factory.mktemp("lines"))
    duckdb.sql(f"copy (select c * 100 + k as l_orderkey, 1 as l_linenumber, 7 as l_partkey, cast(c as bigint) as l_suppkey, (1 + c * k % 17)::double as l_quantity, (100 + c * 37 % 97 + k)::double as l_extendedprice, timestamp '2000-07-01' + to_days(cast(k as integer)) as l_shipdate from range(120) a(c), range(30) b(k)) to '{d}/lineitem.parquet' (format parquet)")
    return d


def exchanges(rows):
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", plan.split("== Initial Plan ==")[0]))


def test_rows_change_places_once_a_phase(spark, lines):
    stages, names = alphas.stages_of(list(range(55, 61)))
    assert exchanges(staged(catalogue.sup(spark, lines), stages).select("code", "date", *names)) == 3
    assert exchanges(staged(catalogue.sup(spark, lines), factors.stages_of("ranks")).select("code", "date", "volume_rank", "return_1d_rank")) == 2
    assert exchanges(catalogue.sup(spark, lines)) == 1


def test_tasks_hold_no_more_rows_of_larger_tables(spark, lines, monkeypatch):
    assert bars.parts(spark, lines) is None
    monkeypatch.setattr(bars, "ROWS_A_TASK", 100)
    assert bars.parts(spark, lines) == 36
    assert catalogue.sup(spark, lines).rdd.getNumPartitions() == 36


def test_tasks_are_dealt_by_rows_before_a_table_has_more_shares_than_spark_partitions(spark, lines, monkeypatch):
    monkeypatch.setattr(bars, "ROWS_A_TASK", 1000)
    assert bars.parts(spark, lines) == 8
    ranks = staged(catalogue.sup(spark, lines), factors.stages_of("ranks"), bars.parts(spark, lines)).select("code", "date", "volume_rank")
    ranks.collect()
    assert ranks.rdd.getNumPartitions() == 8


def longest(stages):
    """The longest frame of rows that ends at its row and has a start."""
    return max(int(n) for n in re.findall(r"between (\d+) preceding", str(stages)))


def test_long_windows_of_formulas_go_by_blocks(spark):
    s = alphas.Sheet(True)
    names = [s.corr(s.open, s.close, 200).sql, s.sum(s.close, 250).sql, s.low_of(s.close, 100).sql, s.mean(s.close, 81).sql]
    assert longest(s.stages) < 30
    draw = np.random.default_rng(3)
    x, y = draw.normal(100, 5, 700).cumsum(), draw.normal(100, 5, 700)
    x[300:560] = 7.0
    rows = [(1, DAY + dt.timedelta(k), float(x[k]), 0.0, 0.0, None if k == 20 else float(y[k]), 1.0, 1.0) for k in range(700)]
    got = staged(spark.createDataFrame(rows, BARS), s.stages).orderBy("date").select(*names).collect()
    for k in range(700):
        full = lambda n: k - n >= 20 or n - 1 <= k < 20  # noqa: B023, E731
        u, v = x[k - 199 : k + 1], y[k - 199 : k + 1]
        want = [np.corrcoef(u, v)[0, 1] if full(200) and u.min() < u.max() else None, y[k - 249 : k + 1].sum() if full(250) else None, y[k - 99 : k + 1].min() if full(100) else None, y[k - 80 : k + 1].mean() if full(81) else None]
        assert [g is None for g in got[k]] == [w is None for w in want]
        assert all(g is None or abs(g - w) < 1e-9 * max(1, abs(w)) for g, w in zip(got[k], want, strict=True))


def test_the_position_in_a_year_goes_by_blocks(spark):
    assert longest(factors.stages_of("position")) < 30
    x = np.random.default_rng(4).normal(100, 5, 600)
    rows = [(1, DAY + dt.timedelta(k), 1.0, 2.0, 0.0, float(x[k]), 1.0, 1.0) for k in range(600)]
    got = staged(spark.createDataFrame(rows, BARS), factors.stages_of("position")).orderBy("date").select("price_position_252d").collect()
    for k, (g,) in enumerate(got):
        w = x[max(0, k - 251) : k + 1]
        assert abs(g - (x[k] - w.min()) / (w.max() - w.min() + 1e-10)) < 1e-12


def test_shares_of_gaps_are_differences_of_counts(spark, lines):
    plan = market._moments(spark, lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RowFrame, -59,") <= 2


def test_ranks_leave_out_what_has_no_value(spark):
    rows = [(c, DAY, 1.0, 2.0, 0.0, close, 1.0, 1.0) for c, close in enumerate([0.0, 1.0, 2.0, 2.0])]
    got = staged(spark.createDataFrame(rows, BARS), catalogue._simple(catalogue.mean_rank)).select("code", "alpha_033").collect()
    assert dict(got) == {0: None, 1: 1.0, 2: 0.5, 3: 0.5}


def test_sums_that_differ_in_their_last_bits_dont_move(spark):
    s = alphas.Sheet(True)
    name = s.corr(s.close, s.open, 2).sql
    closes = [1171568.08, 1171568.0799999998, 1171568.09]
    rows = [(1, DAY + dt.timedelta(k), 10.0 - k, 0.0, 0.0, c, 1.0, 1.0) for k, c in enumerate(closes)]
    assert [r[0] for r in staged(spark.createDataFrame(rows, BARS), s.stages).orderBy("date").select(name).collect()] == [None, None, -1.0]


def test_a_trip_bought_for_nothing_has_no_return(spark):
    t = spark.createDataFrame([(1, DAY, "BUY", 2, 0.0), (1, DAY, "BUY", 1, 5.0), (1, DAY, "BUY", 3, 5.0), (1, DAY, "SELL", 6, 10.0)], "code long, date date, action string, shares long, price double")
    got = sorted((r.shares, r.trip_return) for r in panel.fifo_trips(t).collect())
    assert got == [(1, 1.0), (2, None), (3, 1.0)]


def test_the_audit_and_its_sql_agree_at_the_tolerance(spark, tmp_path):
    d = str(tmp_path)
    duckdb.sql(f"copy (select c as l_orderkey, 1 as l_linenumber, 7 as l_partkey, cast(c as bigint) as l_suppkey, 1.0::double as l_quantity, (90000 + c * 1.37)::double as l_extendedprice, timestamp '2000-07-10' as l_shipdate from range(5000) a(c)) to '{d}/lineitem.parquet' (format parquet)")
    db = duckdb.connect()
    db.execute(f"create view lineitem as select * from '{d}/lineitem.parquet'")
    want = db.execute(catalogue.ORACLE_SQL["staleness_audit"]).fetchall()
    assert [tuple(r) for r in catalogue.QUERIES["staleness_audit"](spark, d).collect()] == want


def test_a_call_holds_what_it_asks_for(tmp_path):
    d = str(tmp_path)
    duckdb.sql(f"copy (select k as id, timestamp '2000-01-01' + to_days(cast(k % 1000 as integer)) as at, md5(k::varchar) as text from range(1500000) a(k)) to '{d}/rows.parquet' (format parquet)")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import datetime as dt, pyarrow as pa; from ledgerline.sources.feeds import ParquetTransport as P; r = P({{'path': {d!r}, 'at': 'at', 'feed': 'rows'}}).fetch('rows', None, dt.date(2000, 1, 3), dt.date(2000, 1, 3)); print(len(r), pa.default_memory_pool().max_memory())"
    n, most = map(int, subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split())
    assert n == 1500 and most < 40_000_000


def test_the_queries_are_read_in_no_time():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    read = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=root, capture_output=True, text=True, check=True, timeout=60)
    assert int(read.stdout) > 100


def test_python_workers_get_small_batches_of_texts(spark, monkeypatch):
    from ledgerline.llm import op6_parity_join as join

    sizes, made = [], join.sets

    def counted(docs, *more):
        def run(batches):
            for b in batches:
                yield b.from_arrays([[b.nbytes]], names=["n"])

        out = made(docs, *more)
        sizes.extend(r.n for r in docs.select("text").mapInArrow(run, "n long").collect())
        return out

    monkeypatch.setattr(join, "sets", counted)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    docs = spark.range(0, 9000, 1, 1).selectExpr("id as doc_id", "concat(repeat(concat(id, ' ', id + 1, ' '), 100), id) as text")
    assert join.linked_documents(docs).count() == 9000
    assert sum(sizes) > 8_000_000 and max(sizes) < 5_000_000
    assert spark.conf.get(key) == was
