"""What the findings of round 4 were about."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from ledgerline.operators import grids
from ledgerline.plans import catalogue, checks, upkeep  # noqa: F401 - register their queries

# -- trips ---------------------------------------------------------------------------------------------------------------


def alike(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and (math.isnan(a) and math.isnan(b) or abs(a - b) <= 1e-6)


@pytest.mark.parametrize("case", ["for nothing", "and sold for nothing", "equal returns", "equal prices"])
@pytest.mark.parametrize("name", ["fifo_trips", "trip_summary"])
def test_trips_equal_their_sql_where_something_was_bought_for_nothing(spark, tmp_path, name, case):
    buy, sell = {"for nothing": ([0.0, 5.0, 4.0], [7.0, 7.0, 3.0]), "and sold for nothing": ([0.0, 5.0, 4.0], [0.0, 7.0, 3.0]), "equal returns": ([2.0] * 3, [3.0] * 3), "equal prices": ([2.0] * 3, [2.0] * 3)}[case]
    rows = [(5 * k, 1, f"timestamp '2024-01-0{k + 1}'", "'purchase'", v) for k, v in enumerate(buy)] + [(5 * k + 15, 1, f"timestamp '2024-01-1{k + 1}'", "'error'", v) for k, v in enumerate(sell)]
    values = ", ".join(f"({i}::bigint, {u}::bigint, {t}, {e}, {v}::double)" for i, u, t, e, v in rows)
    duckdb.sql(f"copy (select * from (values {values}) t(event_id, user_id, ts, event_type, value)) to '{tmp_path}/events.parquet' (format parquet)")
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = sorted(db.execute(catalogue.ORACLE_SQL[name]).fetchall(), key=str)
    got = sorted((tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()), key=str)
    assert len(got) == len(want) and all(alike(a, b) for g, w in zip(got, want, strict=True) for a, b in zip(g, w, strict=True)), (got, want)


# -- formulas ------------------------------------------------------------------------------------------------------------
#: Of the findings.
GROUPS = [6, 15, 11, 17, 12, 14, 16, 7, 5]


@pytest.fixture(scope="module")
def lines(tmp_path_factory):
    """Lines of 90 suppliers and of none, on 280 dates, with gaps, equal bars, lines without a date, and two of some days."""
    d = str(tmp_path_factory.mktemp("lines"))
    r, rows = np.random.default_rng(5), []
    for c in [*range(-3, 87), None]:
        for k in range(280):
            for _ in range(0 if r.random() < 0.1 else 1 + (r.random() < 0.1)):
                price = 500.0 if c == 4 else round(float(r.uniform(100, 900)), 2)
                rows.append((len(rows), 1, 7, c, float(r.integers(1, 50)), price, None if r.random() < 0.0005 else pd.Timestamp("2000-01-01") + pd.Timedelta(days=k)))
    made = pd.DataFrame(rows, columns=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]).astype({"l_suppkey": "Int64", "l_linenumber": "int32"})
    duckdb.sql(f"copy (select * replace (l_shipdate::timestamp as l_shipdate) from made) to '{d}/lineitem.parquet' (format parquet)")
    return d


def shuffled(spark):
    """Bytes written to shuffles so far."""
    sc = spark.sparkContext
    none = lambda: sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none(), False, False, sc._gateway.new_array(sc._jvm.double, 0), none())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("group", GROUPS)
def test_formulas_equal_their_sql_in_few_bytes_and_no_windows(spark, lines, tmp_path, group):
    rows = catalogue.QUERIES[f"formulas_{group}"](spark, lines)
    assert "Window" not in rows._jdf.queryExecution().executedPlan().toString()  # a step of a window function costs some 100 steps of numpy
    before = shuffled(spark)
    rows.write.parquet(f"{tmp_path}/got")
    took = shuffled(spark) - before
    db = duckdb.connect()
    db.execute(f"create view lineitem as select * from '{lines}/lineitem.parquet'")
    db.execute(f"create table want as {catalogue.ORACLE_SQL[f'formulas_{group}']}")
    db.execute(f"create table got as select * from '{tmp_path}/got/*.parquet'")
    assert db.execute("select count(*) from want").fetchone()[0] > 20_000
    assert db.execute("(select * from got except all select * from want) union all (select * from want except all select * from got)").fetchall() == []
    assert took / db.execute("select count(*) from want").fetchone()[0] < 320


def test_what_can_be_made_again_from_bars_is_not_sent():
    g = grids.Grid()
    want = g.rank(g.close - g.open) + g.sum(g.rank(g.mid), 3) * g.mean(g.close, 30)
    assert want.level == 2
    last = grids.sent([want], 2)
    assert {x.op for x in last} == {"rank", "close"} and len(last) == 3
    assert {x.op for x in grids.sent(last, 1)} == {"open", "high", "low", "close"}


def test_a_code_or_date_of_many_batches_is_one_chunk(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(grids, "CHUNK", 10)
    keys = [None] * 3 + [1] * 3 + [2] * 70 + [3] * 5 + [4] * 20
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + 4], pa.int64())], names=["k"]) for k in range(0, len(keys), 4)]
    parts = [t.column(0).to_pylist() for t in grids.chunks(iter(batches), 0)]
    assert [k for p in parts for k in p] == keys
    assert sum(len(set(p)) for p in parts) == 5 and len(parts) > 1

# -- near duplicates -----------------------------------------------------------------------------------------------------
def test_unlike_documents_that_share_words_are_no_cluster(spark, monkeypatch):
    from ledgerline.llm import op6_parity_join as join

    wanted, made = [], join.sets_of

    def counted(texts, rows, words):
        wanted.append(rows.count())
        return made(texts, rows, words)

    monkeypatch.setattr(join, "sets_of", counted)
    r = np.random.default_rng(8)
    passages = [" ".join(f"p{k}w{j}" for j in range(30)) for k in range(61)]
    own = [" ".join(f"d{k}w{j}" for j in r.integers(0, 10**6, 40)) for k in range(60)]
    texts = [f"{passages[k]} {own[k]} {passages[k + 1]}" for k in range(60)]  # each shares a passage with the next
    texts += [f"{texts[k]} more words here" for k in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {d: c for d, _, c in join.linked_documents(docs, words=5, percent=80).collect()}
    sets = [set(join.shingles(t, 5).tolist()) for t in texts]
    linked = {(a, b) for a in range(63) for b in range(a + 1, 63) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert linked == {(0, 60), (1, 61), (2, 62)}
    assert got == {k: k - 60 if k >= 60 else k for k in range(63)}
    assert sum(wanted) <= 10


def test_no_link_is_lost_by_sketches():
    from ledgerline.llm import op6_parity_join as join

    r = np.random.default_rng(9)
    for percent in (80, 90):
        for count in (2, 9, 60):
            base = r.integers(0, 2**63, 200, dtype=np.uint64)
            sets = [np.unique(np.where(r.random(200) < r.uniform(0, 0.15), r.integers(0, 2**63, 200, dtype=np.uint64), base)[: int(r.integers(100, 201))]) for _ in range(count)]
            found = join.within(list(range(count)), [len(s) for s in sets], [join.parity(s, join.fitting(len(s))).tobytes() for s in sets], percent)
            links = join.Links(list(range(count)))
            for a, b in found:
                links.up[max(links.find(a), links.find(b))] = min(links.find(a), links.find(b))
            assert all(links.find(a) == links.find(b) for a in range(count) for b in range(a) if join.linked(sets[a], sets[b], percent))


def test_keys_of_several_documents_are_grouped_once_however_they_are_cut(monkeypatch):
    import pyarrow as pa

    from ledgerline.llm import op6_parity_join as join

    monkeypatch.setattr(join, "GROUP", 4)
    rows = [(1, 7), (2, 5), (2, 6), (2, 6), (3, 5), (3, 6), *((4, k) for k in range(6)), (5, 8), (6, 1), (6, 2), (6, 3)]
    for size in (1, 2, 5, 99):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + size], strict=True)], names=["key", "id"]) for k in range(0, len(rows), size)]
        got = {}
        for b in join.grouped(iter(batches)):
            for g, i, a in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got.setdefault(g, []).append((i, a))
        assert got.pop(None) == [(k, 0) for k in range(6)]
        assert sorted(got.values()) == [[(1, 1), (2, 1), (3, 1)], [(5, 5), (6, 5)]]


def test_stages_of_the_pipeline_get_small_batches_of_texts(spark, monkeypatch, tmp_path):
    import corpus_pipeline

    def sizes(spark, docs, sf_dir):
        def run(batches):
            for b in batches:
                yield b.from_arrays([[b.nbytes]], names=["n"])

        return docs.select("text").mapInArrow(run, "n long")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", sizes)])
    spark.range(0, 9000, 1, 1).selectExpr("id as doc_id", "concat(repeat(concat(id, ' ', id + 1, ' '), 100), id) as text").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.n for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sum(got) > 8_000_000 and max(got) < 5_000_000
