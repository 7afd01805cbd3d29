"""Periodic runs against brute force, SQL and odd rows."""

import hashlib
import os
import random

import duckdb
import pytest

from ledgerline.llm import op12_runs
from ledgerline.llm.op12_runs import collapse, damaged_words, runs_of

SF = "/root/testdata/sf0.001"


def brute_runs(w, least, exponent):
    """Every lag, every longest stretch of it; out if a shorter period fits the whole stretch."""
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and w[i] == w[i - q]:
                i += 1
            x = w[start:i]
            if len(x) >= max(least, exponent * q) and not any(x[d:] == x[:-d] for d in range(1, q)):
                out.append((start, len(x), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(text, key):
    w = damaged_words((text or "").encode().split(), key)
    runs = brute_runs(w, 6, 4)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines, kept = "".join(f"{s},{n},{q}\n" for s, n, q in runs), b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(runs), *((best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4), sha(lines.encode()), sha(kept))


def test_runs_against_every_lag():
    rng = random.Random(12)
    for _ in range(1500):
        v, n = rng.choice([1, 2, 2, 3, 5, 30]), rng.choice([0, 3, 6, 7, 12, 30, 60, 150])
        w = [b"%d" % rng.randrange(v) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            if n:
                a = rng.randrange(n)
                w[a:a] = w[a : a + rng.randrange(1, 12)] * rng.randrange(1, 9)
        least, exponent = rng.choice([4, 6, 9]), rng.choice([3, 4, 4, 5])
        assert runs_of(w, least, exponent) == brute_runs(w, least, exponent)


def test_known_runs():
    assert runs_of(b"a a a a a".split()) == [] and runs_of(b"a a a a a a".split()) == [(0, 6, 1)]
    assert runs_of(b"x a b a b a b a b y".split()) == [(1, 8, 2)]
    # the run ends with a part of its period, and two runs may share words
    assert runs_of(b"a b a b a b a b a".split()) == [(0, 9, 2)]
    assert runs_of(b"a b a b a b a b b b b b b".split()) == [(0, 8, 2), (7, 6, 1)]
    assert collapse(b"x a b a b a b a b y".split(), [(1, 8, 2)]) == b"x a b y"
    with pytest.raises(ValueError):
        runs_of([b"a"] * 9, 6, 2)


def test_long_text_in_linear_steps():
    """A word a hundred thousand times over is one diagonal, not one for each pair."""
    assert runs_of([b"w"] * 100_000) == [(0, 100_000, 1)]
    line = [b"%d" % i for i in range(97)]
    assert runs_of(line * 1000) == [(0, 97_000, 97)]


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: tuple(r)[2:] for r in op12_runs.query(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    short = {i: t for i, t in texts.items() if len(t or "") < 9000}
    assert len(got) == len(texts) and {i: got[i] for i in short} == {i: brute_row(t, i) for i, t in short.items()}


def test_odd_rows(spark):
    made = [(1, None, 1, "x"), (2, "", 1, "x"), (None, "a b " * 9, 1, "x"), (3, "w " * 30000, 1, "x"), (3, "w " * 30000, 1, "x"), (99, " one\ttwo\x0bthree ", None, None)]
    df = spark.createDataFrame(made, "doc_id long, text string, found int, damaged string")
    got = sorted((tuple(r) for r in op12_runs.query(df).collect()), key=str)
    want = sorted((( i, len((t or "").split()), *brute_row(t, i)) for i, t, *_ in made if i != 3), key=str)
    assert [r for r in got if r[0] != 3] == want and len([r for r in got if r[0] == 3]) == 2
    assert op12_runs.query(df.limit(0)).count() == 0
    whole = op12_runs.with_runs(df, name="_found")
    assert whole.columns == [*df.columns, "_found"] and whole.count() == 6
    with pytest.raises(ValueError):
        op12_runs.with_runs(df)


def test_sql(spark):
    rows = sorted(map(tuple, op12_runs.query(spark.read.parquet(f"{SF}/documents.parquet")).collect()))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{os.path.join(SF, 'documents.parquet')}'")
    assert sorted(db.execute(op12_runs.SQL).fetchall()) == rows
