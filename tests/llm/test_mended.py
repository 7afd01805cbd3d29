"""Cases that earlier rounds got wrong."""

import math

import pytest

from ledgerline.llm import op1_mtree, op5_mixing, op6_parity_join, op7_warc, op8_extract


def test_vectors_beyond_a_long(spark):
    """Components up to the largest double; what is left is searched as if they weren't there."""
    rows = [(50, [1.0, 0.5]), (1, [0.25, 2.0]), (2, [1e30, 0.0]), (3, [-1e300, 1.0]), (100, [1e12, 1e12]), (4, [8e6, 0.0]), (150, [3e6, -3e6]), (5, [4.1e6, 7.5e6])]
    got = op1_mtree.query(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    fit = {i: v for i, v in whole.items() if sum(x * x for x in v) < 2**62}
    assert set(fit) == {50, 1, 4, 150}  # 5 is just too long
    for q in (50, 150):
        want = sorted(((-sum(a * b for a, b in zip(fit[q], fit[i], strict=True)), i) for i in fit if i != q))[:5]
        assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert {r.query_id for r in got} == {50, 150}


DEEP = "<div>" * 250


@pytest.mark.parametrize("html, text", [
    (DEEP + "<script>var x=1</script><style>p{}</style><nav>menu <b>x</b><br></nav><p>real</p>", "real"),
    (DEEP + "<p>a</p><div class='comments'><p>b</p><div>c<img></div></div><p>d</p>", "a\nd"),
    (DEEP + "<form><input><p>no</p></form><div hidden>no</div><div role='search'>no</div><p>yes</p>" + "</div>" * 250 + "<p>after</p>", "yes\nafter"),
])
def test_roles_below_the_deepest_element(html, text):
    assert [x.split() for x in op8_extract.extract([html])[0].split("\n")] == [x.split() for x in text.split("\n")]


def test_a_sentence_that_few_pages_quote_stays(spark):
    """4 of 31 pages of a host share a paragraph at one place, and alignment pairs it there; what all of them share goes."""
    page = lambda k: "<article><h1>Title {0}</h1><p>Own words of page {0}.</p>{1}<p>More of {0} to read.</p><p>Thanks for reading our site.</p></article>".format(k, "<p>The same quotation here.</p>" if k < 4 else f"<p>Another thing {k}.</p>" if k % 3 else "")
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(31)]
    got = {r.page_id: r.text for r in op8_extract.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(("The same quotation here." in got[k]) == (k < 4) for k in got) and not any("Thanks" in t for t in got.values())
    assert got[0] == "Title 0\nOwn words of page 0.\nThe same quotation here.\nMore of 0 to read."
    assert op8_extract.extract([h for *_, h in rows]) == [got[k] for k in range(31)]


def test_which_row_of_a_repeated_id_stays(spark):
    """The least text, whatever the order of the rows; columns and their names come through."""
    rows = [(7, "beta words", 1, "x"), (7, "alpha words", 2, "y"), (7, "alpha words", 2, "y"), (8, None, 3, "z"), (None, "alpha words", 4, "n"), (None, "alpha words", 5, "n")]
    for k in range(3):
        df = spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string, row int, at string").repartition(3)
        got = op6_parity_join.keep_one(df)
        assert got.columns == df.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted([(7, "alpha words", 2, "y"), (8, None, 3, "z"), (None, "alpha words", 4, "n"), (None, "alpha words", 5, "n")], key=str)


def test_small_pages_don_t_meet(spark, tmp_path):
    """Many empty pages and copies of a small one are responses each; copies of a large one are revisits of the largest id."""
    rows = [(k, None, None) for k in range(40)] + [(100 + k, "u", "small") for k in range(40)] + [(200 + k, "u", "large " * 300) for k in range(5)]
    got = {r.page_id: (r.record_type, r.refers_to) for r in op7_warc.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 85 and {v for k, v in got.items() if k < 200} == {("response", None)} and got[204] == ("response", None) and {got[200 + k] for k in range(4)} == {("revisit", 204)}


def test_parts_of_shards_grow(spark, monkeypatch):
    """With few documents a part there are many parts; the rows are the same."""
    df = spark.createDataFrame([(k, f"s{k % 3}", "some words here") for k in range(300)], "doc_id long, source string, text string")
    few = sorted(r.doc_id for r in op5_mixing.shards(df, shards=2).collect())
    monkeypatch.setattr(op5_mixing, "DOCS_A_PART", 3)
    many = op5_mixing.shards(df, shards=2)
    assert sorted(r.doc_id for r in many.collect()) == few and ", 50)" in many._jdf.queryExecution().optimizedPlan().toString()
