"""Periodic runs of words by an online sparse diagonal DP.

A run is a longest stretch of words that repeats with its smallest period q at least MIN_EXPONENT times over. A word that
equals the word d before it lies on diagonal d; a run of period q is a piece of diagonal q. The DP walks a document's words
once: at each word its earlier occurrences lengthen the active diagonals of their lags, and a diagonal that gets nothing
ends and emits its run at once, if it is long enough.

Sparse: of the earlier occurrences of a word only those count that can be a smallest period. With m the least power of
two that isn't below q, the m words that end at a word of the run occurred before at lag q and at no shorter lag (two
periods of which the sum isn't more than the stretch give their common divisor as a period, and q is the smallest).
So for each m only the nearest earlier occurrence of the last m words counts, and only if its lag is in (m / 2, m]:
at most one diagonal for each power of two, n log n steps for n words, and no pair of words is looked at twice.

Every document is worked on by itself, so nothing is shuffled. Defined cases: a null or empty text has no words and no runs
and the digests of the empty string; a null id is a document like any other, which the damage of the query leaves
alone; repeated rows give repeated rows; very long texts are taken whole; runs of equal length tie to the smaller start, then
the smaller period; an empty table gives an empty result; further columns take no part in query() and come through
with_runs(), whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_sql, free_name, with_arrow_column

#: A run has at least so many words, and at least so many periods (3 or more, so that m words fit behind the first period).
MIN_WORDS, MIN_EXPONENT = 6, 4

_RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
_KIND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])
_ARROW = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))), ("collapsed", pa.string())])


def occurrences(ids: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each power of two m: the words at which m words end that occurred before, and the lag, where it is in (m / 2, m]."""
    n, m, grams = len(ids), 1, ids
    while (m // 2 + 1) * exponent <= n:
        at = np.flatnonzero(grams >= 0)
        at = at[np.argsort(grams[at], kind="stable")]
        same = grams[at[1:]] == grams[at[:-1]]
        lags, starts = (at[1:] - at[:-1])[same], at[1:][same]
        keep = (lags > m // 2) & (lags <= m)
        yield starts[keep] + m - 1, lags[keep]
        again = np.append(same, False) | np.insert(same, 0, False)
        if not again.any() or (m + 1) * exponent > n:
            return
        # names of twice as many words: pairs of names; what occurs once can't occur twice with more words
        names = np.full(len(grams), -1)
        names[at[again]] = np.cumsum(np.insert(~same, 0, True))[again] - 1
        left, right = names[: len(grams) - m], names[m:]
        grams = np.where((left >= 0) & (right >= 0), left * n + right, -1)
        m *= 2


def runs_of(words: list[bytes], min_words: int = MIN_WORDS, exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    if exponent < 3:
        raise ValueError("a run needs three periods or more")
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    if len(index) == len(words):
        return []
    found = list(occurrences(ids, exponent))
    ends = np.concatenate([e for e, _ in found]) if found else np.zeros(0, np.int64)
    if not len(ends):
        return []
    lags = np.concatenate([x for _, x in found])
    order = np.argsort(ends, kind="stable")
    runs: list[tuple[int, int, int]] = []
    active: dict[int, int] = {}  # lag -> first word of the run whose diagonal is still matched

    def ended(lag: int, last: int) -> None:
        start = active.pop(lag)
        length = last - start + 1
        if length >= max(min_words, exponent * lag):
            runs.append((start, length, lag))

    matched: list[int] = []
    now = -2
    for word, lag in zip(ends[order].tolist(), lags[order].tolist(), strict=True):
        if word != now:
            for x in [x for x in active if x not in matched] if word == now + 1 else [*active]:
                ended(x, now if x in matched else now - 1)
            now, matched = word, []
        matched.append(lag)
        if lag not in active:  # its diagonal begins with all the words that have matched
            active[lag] = word - (1 << (lag - 1).bit_length()) + 1 - lag
    for x in [*active]:
        ended(x, now if x in matched else now - 1)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those of a run after its first period, joined by single spaces."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    inside = np.cumsum(edge)
    return b" ".join([w for w, x in zip(words, inside.tolist(), strict=False) if not x])


def with_runs(docs: DataFrame, text_col: str = "text", name: str = "found", min_words: int = MIN_WORDS, exponent: int = MIN_EXPONENT) -> DataFrame:
    """All columns and one more, a struct: n_words, runs (start, length, period), collapsed (the text without repeats). A name that
    docs has already raises."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {name}")

    def make(texts: pa.Array) -> pa.Array:
        made = []
        for t in texts.cast(pa.binary()).to_pylist():
            words = (t or b"").split()
            runs = runs_of(words, min_words, exponent)
            made.append({"n_words": len(words), "runs": [{"start": a, "length": n, "period": q} for a, n, q in runs], "collapsed": collapse(words, runs).decode()})
        return pa.array(made, _ARROW)

    return with_arrow_column(docs, name, _KIND, make, [text_col])


def damaged_words(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth document, by the checksum of its id, repeats a stretch of its words up to its end."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def damaged(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the damage that the query plants."""

    def make(ids: pa.Array, texts: pa.Array) -> pa.Array:
        rows = zip(ids.to_pylist(), texts.cast(pa.binary()).to_pylist(), strict=True)
        return pa.array([b" ".join(damaged_words((t or b"").split(), i)).decode() for i, t in rows], pa.string())

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = free_name(narrow, "damaged")
    return with_arrow_column(narrow, made, T.StringType(), make, ["doc_id", "text"]).select("doc_id", F.col(made).alias("text"))


def query(docs: DataFrame) -> DataFrame:
    found = with_runs(damaged(docs)).select("doc_id", "found.*")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select("doc_id", "n_words", "runs", "collapsed", longest.alias("longest")).select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.s")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.p")).alias("period"),
        F.expr("1000 * longest.length div -longest.p").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, CRC as h from documents),
w as (select row_number() over () as k, doc_id, h, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
n as (select *, len(words) as n, case when len(words) > 0 then (h // 10) % len(words) else 0 end as a from w),
p as (select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from n),
g as (select k, doc_id, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: case when i >= a then words[1 + a + (i - a) % p] else words[1 + i] end) else words end as words from p),
t as (select k, unnest(range(len(words))) as i, unnest(words) as word from g),
-- five words in a row at one lag are the least that a run needs
f as (select k, i, word || ' ' || lead(word) over o || ' ' || lead(word, 2) over o || ' ' || lead(word, 3) over o || ' ' || lead(word, 4) over o as five from t window o as (partition by k order by i)),
m as (select x.k, x.i - y.i as q, x.i from f x join f y on x.k = y.k and x.five = y.five and y.i < x.i),
s as (select k, q, i, i - row_number() over (partition by k, q order by i) as island from m),
c as (select k, q, min(i) - q as start, max(i) + 5 - min(i) + q as length from s group by k, q, island having max(i) + 5 - min(i) + q >= greatest(6, 4 * q)),
r as (select * from c where not exists (select 1 from c as b where b.k = c.k and b.q < c.q and b.start <= c.start and b.start + b.length >= c.start + c.length)),
x as (select k, count(*) as n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' order by start, q) as lines,
             min({'l': -length, 's': start, 'q': q}) as best from r group by k),
gone as (select distinct k, unnest(range(start + q, start + length)) as i from r),
kept as (select t.k, string_agg(word, ' ' order by t.i) as rest from t left join gone on gone.k = t.k and gone.i = t.i where gone.i is null group by t.k)
select doc_id, len(words)::bigint as n_words, coalesce(n_runs, 0)::bigint as n_runs, best.s::bigint as start, (-best.l)::bigint as length, best.q::bigint as period,
       ((-1000 * best.l) // best.q)::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(rest, '')) as collapsed_sha256
from g left join x using (k) left join kept using (k)
""".replace("CRC", crc32_sql("cast(doc_id as varchar)"))
