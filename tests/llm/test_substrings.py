"""Repeated passages against brute force, SQL and odd rows."""

import hashlib
import os
import random
from collections import defaultdict

import duckdb
import pytest

from ledgerline.llm import op11_substrings

SF = "/root/testdata/sf0.001"


def brute(rows, window):
    """rows: (id, text), ids may repeat; every window in a dictionary of its least document."""
    key = lambda i: 2**63 - 1 if i is None else i
    split = [(i, (t or "").encode().split()) for i, t in rows]
    least = defaultdict(lambda: 2**63 - 1)
    for i, w in split:
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            least[x] = min(least[x], key(i))
    out = []
    for i, w in split:
        gone = {k + j for k in range(len(w) - window + 1) if least[tuple(w[k : k + window])] < key(i) for j in range(window)}
        spans = [k for k in sorted(gone) if k - 1 not in gone]
        ends = [k for k in sorted(gone) if k + 1 not in gone]
        out.append((i, len(w), len(gone), [(a, b - a + 1) for a, b in zip(spans, ends, strict=True)], b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, [tuple(s) for s in r.spans], r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("window, prefix, common", [(13, 8, 1 << 16), (13, 8, 3), (5, 3, 10), (2, 1, 2)])
def test_against_every_window(spark, monkeypatch, window, prefix, common):
    rng = random.Random(window)
    monkeypatch.setattr(op11_substrings, "COMMON", common)
    monkeypatch.setattr(op11_substrings, "BLOCK_BYTES", 4000)
    passages = [[f"p{rng.randrange(40)}" for _ in range(rng.choice([12, 13, 14, 60]))] for _ in range(6)]
    rows = []
    for k in range(160):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([0, 5, 13, 40, 300]))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        rows.append((rng.choice([k, k, 7, None]), rng.choice([" ", "\n", "\t \x0b"]).join(w)))
        if k % 5 == 0:
            rows.append((1000 + k, rows[-1][1] + rng.choice(["", " tail"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(op11_substrings.deduplicated(df, window=window, prefix=prefix)) == brute(rows, window)


def test_query_against_brute_force_and_sql(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, op11_substrings.query(df).collect()))
    want = brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], 13)
    assert got == sorted((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, _, kept in want)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{os.path.join(SF, 'documents.parquet')}'")
    assert sorted(db.execute(op11_substrings.SQL).fetchall()) == got


def test_documents_are_shuffled_once(spark):
    """The exchange of documents is made once and used by both rounds and the result."""
    df = op11_substrings.query(spark.read.parquet(f"{SF}/documents.parquet"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("REPARTITION_BY_NUM") - plan.count("ReusedExchange") <= 1, plan


def test_odd_rows(spark):
    long, common = "é w " * 40_000, "thirteen words that any of these rows may have in it twice or more"
    rows = [(1, None), (2, ""), (None, common), (3, long), (3, long), (4, common), (5, "so " + common + " x"), (5, common), (-6, " \n"), (9, long)]
    df = spark.createDataFrame([(*r, 1, "z", b"b") for r in rows], "doc_id long, text string, block int, `to` string, names binary")
    assert rows_of(op11_substrings.deduplicated(df)) == brute(rows, 13)
    assert op11_substrings.query(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        op11_substrings.deduplicated(df, window=3, prefix=3)
