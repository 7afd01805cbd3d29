"""The ten operators against brute force, round trips and odd rows."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import op1_mtree, op2_ctw, op3_bpe, op4_toxicity, op5_mixing, op6_parity_join, op7_warc, op8_extract, op9_sharding, op10_quality
from ledgerline.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, measured int, mix int, p string"
ODD = [(1, None, "en", None, 0, 1, 1, "x"), (2, "", "en", "a", 0, 1, 1, "x"), (None, "a b c", "en", "a", 5, 1, 1, "x"), (3, "w " * 3000, "en", "b", 6000, 1, 1, "x"), (3, "w " * 3000, "en", "b", 6000, 1, 1, "x"), (4, "Some words are here to stay and more of them come along as we go on and on until twenty are reached.", None, "b", 9, 1, 1, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(rows, n, percent):
    sets = {i: shingle_set(t, n) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_parity_join(spark, docs, n, percent, monkeypatch):
    rng, base = random.Random(n), [f"w{i}" for i in range(400)]
    made = []
    for k in range(120):
        size = rng.choice([2, 7, 12, 20, 45, 90, 200])
        start = rng.randrange(0, 5) * 60
        w = base[start : start + size]
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        made.append((10_000 + k, " ".join(w)))
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()] + made
    monkeypatch.setattr(op6_parity_join, "BLOCK", 8)
    got = op6_parity_join.linked_documents(spark.createDataFrame(rows, "doc_id long, text string"), words=n, percent=percent)
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == brute_components(rows, n, percent)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    up = {i: i for e in edges for i in e}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for e in edges if e[0] != e[1] for i in e}


def test_mtree_is_exact(spark):
    rng = np.random.default_rng(3)
    vectors = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(900)]
    vectors += [(int(900 + i), vectors[0][1]) for i in range(300)] + [(5000, None), (5050, [1.0, None]), (5100, [float("nan")]), (5150, []), (None, [1.0] * 6)]
    got = op1_mtree.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, v in ok:
        if q is not None and q % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), i if i is not None else 1 << 60, i) for i, w in ok if i != q))[:5]
            want |= {(q, k, i, -s) for k, (s, _, i) in enumerate(best, 1)}
    assert {(r[0], r[1], r[2], r[3]) for r in got} == want


def test_mtree_avoids_distances_and_takes_odd_rows(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.integers(-3, 3, (300, 4)) + 200 * c for c in rng.integers(-9, 9, (12, 4))])
    most = int((x * x).sum(1).max())
    tree = op1_mtree.Tree(op1_mtree.build(0, 0, np.arange(len(x)).astype(object), x, most), 4, most)
    for q in range(0, len(x), 300):
        want = sorted(((-int(x[q] @ v), i) for i, v in enumerate(x) if i != q))[:5]
        assert sorted((-s, i) for s, i in tree.search(q, x[q], 5, None)) == want
    assert tree.avoided > 0 and tree.computed < 12 * len(x)
    schema = "vec_id long, embedding array<double>, id long, v int, cell int, norm int"
    assert op1_mtree.top_k(spark.createDataFrame([], schema)).count() == 0
    twice = spark.createDataFrame([(0, [1.0, 0.0], 1, 1, 1, 1), (0, [0.0, 1.0], 1, 1, 1, 1), (1, [1.0, 1.0], 1, 1, 1, 1)], schema)
    assert [(r[0], r[1], r[2], r[3]) for r in op1_mtree.top_k(twice).collect()] == [(0, 1, 1, 65536)]


def test_bpe_as_tiktoken(docs, odd):
    import public_tokenizers
    import tiktoken

    tokens = op3_bpe.read_ranks(public_tokenizers.path(op3_bpe.VOCABULARY))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    for frame in (docs, odd):
        texts = [(r[0], r[1] or "") for r in frame.select("doc_id", "text").collect()]
        got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op3_bpe.query(frame).collect())
        want = []
        for i, t in texts:
            ids = np.array(own.encode_ordinary(t), "<u4")
            want.append((str(i), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
        assert got == sorted(want)


def test_ctw_against_a_tree_of_dictionaries(spark):
    from math import exp, lgamma, log, log10, pi

    texts = ["abracadabra abra", "cadabra abracadabra", "the end of the end", "", "abra the cat"] * 4
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in op2_ctw.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    counts: dict = {}

    def visit(text, use):
        b = bytes(op2_ctw.DEPTH) + text.encode()
        for at in range(op2_ctw.DEPTH, len(b)):
            for k in range(8):
                node, bit = (1 << k) | (b[at] >> (8 - k)), (b[at] >> (7 - k)) & 1
                use([(node, b[at - d : at]) for d in range(op2_ctw.DEPTH + 1)], bit)

    def learn(path, bit):
        for p in path:
            counts.setdefault(p, [0, 0])[bit] += 1

    for i, t in rows:
        if not held[i]:
            visit(t, learn)
    pe = {p: lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(pi) for p, (a, b) in counts.items()}
    children: dict = {}
    for node, c in counts:
        if c:
            children.setdefault((node, c[1:]), []).append((node, c))
    pw: dict = {}
    for p in sorted(counts, key=lambda p: -len(p[1])):
        below = sum(pw[c] for c in children.get(p, ()))
        pw[p] = pe[p] if len(p[1]) == op2_ctw.DEPTH else log((exp(pe[p]) + exp(below)) / 2)

    def probability(path, bit):
        known = [p for p in path if p in counts]
        if not known:
            return 0.5
        kt = lambda p: (counts[p][bit] + 0.5) / (sum(counts[p]) + 1)
        out = kt(known[-1])
        for p in reversed(known[:-1]):
            a = exp(pe[p] - pw[p]) / 2
            out = a * kt(p) + (1 - a) * out
        if len(known) <= op2_ctw.DEPTH:  # the deepest met context answers for those below it
            pass
        return out

    # the end: context-tree weighting of depth one over whether a byte or the end follows
    follows: dict = {}
    for i, t in rows:
        if not held[i]:
            b = b"\0" + t.encode()
            for k in range(len(b)):
                follows.setdefault(b[k], [0, 0])[k == len(b) - 1] += 1
    all_ = [sum(f[k] for f in follows.values()) for k in (0, 1)]
    kt_log = lambda a, b: lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(pi)
    leaves = sum(kt_log(*f) for f in follows.values())
    weight = 1 / (1 + exp(leaves - kt_log(*all_)))

    def end(before, k):
        upper = (all_[k] + 0.5) / (sum(all_) + 1)
        f = follows.get(before)
        return upper if f is None else weight * upper + (1 - weight) * (f[k] + 0.5) / (sum(f) + 1)

    counted: dict = {}
    for i, t in rows:
        if not held[i]:
            for w in [*words(t), b""]:
                counted[w] = counted.get(w, 0) + 1
    n_all = sum(counted.values())
    for i, t in rows:
        total = []
        visit(t, lambda path, bit: total.append(log10(probability(path, bit))))
        b = b"\0" + t.encode()
        total += [log10(end(b[k], int(k == len(b) - 1))) for k in range(len(b))]
        assert got[i]["score"] == pytest.approx(sum(total), abs=1e-6)
        tokens = [*words(t), b""]
        base = sum(log10((counted.get(w, 0) + 0.1) / (n_all + 0.1 * (len(counted) + 1))) for w in tokens)
        assert got[i]["base_score"] == pytest.approx(base, abs=1e-9) and got[i]["train_tokens"] == n_all
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["held_out"]) == (len(tokens), sum(w in counted for w in tokens), held[i])


def test_ctw_odd_rows(spark, odd, monkeypatch):
    """Texts longer than a piece, several blocks and shards: the scores are those of one block."""
    long = [(100 + k, f"word{k} and others " * 300) for k in range(6)]
    rows = spark.createDataFrame([(r[0], r[1]) for r in ODD] + long, "doc_id long, text string")
    one = sorted(map(tuple, op2_ctw.scores(rows).collect()), key=repr)
    monkeypatch.setattr(op2_ctw, "BLOCK_BYTES", 9_000)
    monkeypatch.setattr(op2_ctw, "PIECE", 2_000)
    many = sorted(map(tuple, op2_ctw.scores(rows).collect()), key=repr)
    assert len(one) == len(many) == len(ODD) + 6
    for a, b in zip(one, many, strict=True):
        assert a[:5] == b[:5] and a[7] == b[7] and a[5:7] == pytest.approx(b[5:7], abs=1e-6)
    empty = {r[0]: r for r in one if r[0] in (1, 2)}
    assert empty[1][2:4] == empty[2][2:4] == (1, 1) and empty[1][6] == empty[2][6] < 0


def test_toxicity_held_out(spark):
    big = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    test = F.col("doc_id") % 4 == 0
    chain = op4_toxicity.train(docs, labels.filter(~test))
    got = op4_toxicity.with_probabilities(docs, chain, "p").join(labels.filter(test), "doc_id").select(F.col("p.toxic") >= 0.5, "toxic").collect()
    hits, toxic = sum(a and b == 1 for a, b in got), sum(b == 1 for _, b in got)
    assert sum(a and b == 0 for a, b in got) <= 0.02 * len(got) and hits >= 0.7 * toxic


def test_mixing(docs, odd):
    got = op5_mixing.query(docs).toPandas()
    again = op5_mixing.query(docs.repartition(3)).toPandas()
    assert sorted(map(tuple, got[["doc_id", "taken"]].to_numpy())) == sorted(map(tuple, again[["doc_id", "taken"]].to_numpy()))
    assert (got["taken"] <= 3 * got["size"]).all() and len(got) == docs.count()
    d = docs.select("doc_id", "source").toPandas().merge(got, on="doc_id").groupby("source").agg(target=("target", "first"), size=("source_size", "first"), taken=("taken", "sum"))
    assert ((d.taken - d.target).abs() <= 0.05 * d.target + 100).all() and (d.target <= 3 * d["size"] + 1e-6).all()
    assert d.target.sum() == pytest.approx(d["size"].sum())
    assert op5_mixing.query(odd).count() == len(ODD)
    assert (op5_mixing.split(np.array([5, 0, 17]), 4, 1).sum(axis=0) == [5, 0, 17]).all()


def test_mixing_target_and_clashing_names(spark, docs):
    sizes = {r[0]: r[1] for r in docs.groupBy("source").agg(F.sum(op5_mixing.words(F.col("text")))).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    # by bisection: the level at which min(weight * level, 3 * size) sums to all words
    lo, hi = 0.0, float(sum(sizes.values()) * 10)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(weight[s] * mid, 3 * sizes[s]) for s in order) < sum(sizes.values()) else (lo, mid)
    got = {r[0]: (r[1], r[2]) for r in docs.select("doc_id", "source").join(op5_mixing.query(docs), "doc_id").select("source", "source_size", "target").distinct().collect()}
    assert set(got) == set(sizes) and all(got[s][0] == sizes[s] and got[s][1] == pytest.approx(min(weight[s] * hi, 3 * sizes[s])) for s in order)
    names = ["_source", "_size", "_block", "whole", "_shard", "row", "mix", "size", "order", "shard", "at", "part", "null", "block", "copy"]
    odd = spark.createDataFrame([(i, "ab"[i % 2], f"w{i} x y", *[f"{n}{i}" for n in names]) for i in range(40)], "doc_id long, source string, text string, " + ", ".join(f"`{n}` string" for n in names))
    mixed = op5_mixing.shards(odd)
    rows = {tuple(r) for r in odd.collect()}
    assert mixed.columns == odd.columns and {tuple(r) for r in mixed.collect()} <= rows
    nulls = spark.createDataFrame([(None, None, "a b c"), (None, None, None), (None, None, "a b c"), (None, "s", "d")], "doc_id long, source string, text string")
    assert sorted(r["size"] for r in op5_mixing.query(nulls).collect()) == [0, 1, 3, 3]


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(op7_warc, "SEGMENT", 500)
    big = "<p>é</p>" * 400
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, None), (4, "http://c d/", "x\r\n\r\nWARC/1.1 trap"), (5, "", "y" * 1000), (None, "u", "z" * 1200), (2, "http://b/", big), (None, "v", big)]
    got = sorted((str(r[0]), r[1], r[2], r[3], r[4]) for r in op7_warc.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = sorted((str(i), len((h or "").encode()), sha(h), "revisit" if h == big and i != 2 else "response", 2 if h == big and i != 2 else None) for i, _, h in rows)
    assert got == want
    assert op7_warc.joined([(1, None, b"a"), (3, 3, b"b")]) is None and op7_warc.joined([(1, None, b"a"), (2, 3, b"b")]) is None
    assert op7_warc.unframed(op7_warc.chunked(b"abc" * 9000)) == b"abc" * 9000 and op7_warc.unframed(op7_warc.chunked(b"abc")[:-9]) is None


def test_warc_malformed(spark, tmp_path):
    import gzip
    import io

    good = op7_warc.record("response", {"WARC-Record-ID": "<a>", "X-Page-ID": 7}, op7_warc.chunked(b"abc")) + b"\r\n\r\n"
    bad = [good.replace(b"Content-Length: ", b"Content-Length: x"), good.replace(b"X-Page-ID: 7", b"X-Page-ID: seven"), good.replace(b"<a>", b"<a>\r\nWARC-Segment-Number: 1st")]
    read = lambda data: list(op7_warc.parse(io.BytesIO(data)))
    assert [r[0] for r in read(b"noise\r\n" + good + good)] == [7, 7]
    for b in bad:
        got = read(b + good)
        assert got[0][-1] is None and got[-1][-1] == op7_warc.chunked(b"abc")
    assert read(good[:-20])[0][-1] is None and read(b"") == []
    packed = gzip.compress(good * 50)
    (tmp_path / "cut.gz").write_bytes(packed[: len(packed) // 2])
    (tmp_path / "whole.gz").write_bytes(packed)
    pages = op7_warc.reassemble(op7_warc.read_records(spark, str(tmp_path))).collect()
    assert 50 <= len(pages) <= 101 and all(p["payload"] in (None, b"abc") for p in pages)
    head = b"HTTP/1.1 200 OK\r\n%b\r\n\r\n"
    framed = op7_warc.chunked(b"abc").partition(b"\r\n\r\n")[2]
    assert op7_warc.unframed(head % b"X-Note: Transfer-Encoding: chunked" + framed) == framed
    assert op7_warc.unframed(head % b"transfer-encoding:chunked" + framed) == b"abc"
    assert all(op7_warc.unframed(head % b"Transfer-Encoding: chunked" + x + framed[1:]) is None for x in (b"+3", b"-3", b"0x3", b""))
    assert op7_warc.query(spark.createDataFrame([], "page_id long, url string, html string, type string")).count() == 0


def test_toxicity_sample_is_of_documents(spark):
    docs = spark.createDataFrame([(i, f"some words {'foul' if i % 2 else 'fine'}") for i in range(80)], "doc_id long, text string")
    label = lambda ids: spark.createDataFrame([(i, i % 3 % 2, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    want, got = (op4_toxicity.train(docs, label(range(n)), sample=80) for n in (80, 8000))
    assert "foul$" in want.vocabulary and got.vocabulary == want.vocabulary
    assert all(np.allclose(a.weights, b.weights) and a.bias == pytest.approx(b.bias) for a, b in zip(got.models, want.models, strict=True))


def test_toxicity_odd_rows(spark, odd):
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for rows in ([], [(1, None, None), (None, 1, 1), (77, 1, 0)], [(1, 1, 0), (3, 0, 1), (3, None, 0), (4, 1, 1)]):
        assert op4_toxicity.keep_clean(odd, label(rows)).columns == odd.columns
        p = op4_toxicity.with_probabilities(odd, op4_toxicity.train(odd, label(rows)), "chances").select("chances.*").collect()
        assert len(p) == len(ODD) and all(0 <= x <= 1 for r in p for x in r)
        assert op4_toxicity.keep_clean(odd.limit(0), label(rows)).count() == 0


def test_toxicity_folds_choose_their_own_features(spark):
    """A feature of one fold's documents only has no say in what the other folds' models give that fold."""
    seen = []
    real = op4_toxicity.Chain.fit.__func__

    def fit(cls, categories, vocabulary, of_fold, present, labels, folds):
        seen.append((vocabulary, of_fold, present, folds))
        return real(cls, categories, vocabulary, of_fold, present, labels, folds)

    docs = spark.createDataFrame([(i, f"some plain words {'foul' if i % 2 else 'fine'} {'onlyhere' if i % 5 == 3 and i % 2 else ''}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 % 2, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(op4_toxicity.Chain, "fit", classmethod(fit))
        op4_toxicity.train(docs, labels)
    vocabulary, of_fold, present, folds = seen[0]
    at = vocabulary["onlyhere$"]
    assert at not in of_fold[3] and all(at in of_fold[f] for f in (0, 1, 2, 4))


def test_bpe_of_another_pattern(spark):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(op3_bpe.VOCABULARY)
    tokens = op3_bpe.read_ranks(path)
    own = tiktoken.Encoding("own", pat_str=r"\S+ \S+|\s+|\S+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    texts = ["one two three four", " a  b c d e f", ""]
    got = op3_bpe.decode(op3_bpe.encode(spark.createDataFrame([(t,) for t in texts], "text string"), path, r"\S+ \S+|\s+|\S+"), path).collect()
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == own.encode_ordinary(r["text"]) and bytes(r["decoded"]).decode() == r["text"]


def test_extraction(spark):
    page = lambda i: f"<html><body><div class='topbar'>Site</div><div><p>Same on all</p></div><div><p>Own {i} &amp; x</p><p>more&nbsp;{i}</p></div><form>f</form></body></html>"
    assert op8_extract.extract([page(i) for i in range(6)])[2] == "Own 2 & x\nmore 2"
    art = "<nav>n</nav><article><header><h1>T</h1></header><p>a <b>b</b>c<br>d<p>e<aside>s</aside><section id='comments'>no</section></article><footer>f"
    assert op8_extract.extract([art]) == ["T\na bc d\ne"]
    got = op8_extract.query(spark.createDataFrame([(1, None, None), (2, "http://h/", ""), (None, "x", "<p>hi")], "page_id long, url string, html string")).collect()
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == [("1", "", 0), ("2", "", 0), ("None", "hi", 2)]


def test_extraction_aligns_marked_articles():
    page = lambda i: f"<body><article><h1>T{i}</h1><div class='cta'>Join us</div><p>Own {i}</p><p class='notice'>Note {i}</p><div class='related'><a href=x>See {i}</a></div></article></body>"
    assert op8_extract.extract([page(i) for i in range(6)])[2] == "T2\nOwn 2\nNote 2"
    assert op8_extract.extract([page(2)]) == ["T2\nJoin us\nOwn 2\nNote 2"]


def test_extraction_by_size_of_host_and_input(spark):
    page = lambda h, i: (i, f"http://{h}/{i}", f"<body><div><p>Menu</p></div><div><p>Own {i}</p></div></body>")
    for many, others in ((5, 0), (258, 0), (320, 2180)):
        rows = [page("a", i) for i in range(many)] + [page(f"h{i % 20}", i) for i in range(others)]
        got = op8_extract.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert len(got) == many + others and all(r["text"] == f"Own {r['page_id']}" for r in got)


def test_extraction_votes_by_distinct_pages(spark):
    page = lambda i: f"<body><div><p>Menu</p></div><div><p>Own {i}</p><p>more {i}</p></div></body>"
    copies = [page(0)] * 40 + [page(i) for i in range(1, 5)]
    sparse = ["<body><p>Error</p></body>"] + [page(i) for i in range(1, 7)]
    rows = [(i, "http://c/", h) for i, h in enumerate(copies)] + [(100 + i, "http://s/", h) for i, h in enumerate(sparse)]
    got = {r["page_id"]: r["text"] for r in op8_extract.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(44)] == op8_extract.extract(copies) == ["Own 0\nmore 0"] * 40 + [f"Own {i}\nmore {i}" for i in range(1, 5)]
    assert [got[100 + i] for i in range(7)] == op8_extract.extract(sparse) == ["Error"] + [f"Own {i}\nmore {i}" for i in range(1, 7)]


def plain_matching(a, b, x=0, y=0):
    """Simple tree matching as published, over all pairs of children."""
    if a.labels[x] != b.labels[y]:
        return 0
    p, q = a.kids[x], b.kids[y]
    m = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i in range(1, len(p) + 1):
        for j in range(1, len(q) + 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + plain_matching(a, b, p[i - 1], q[j - 1]))
    return m[-1][-1] + 1


@pytest.mark.parametrize("cells", [1 << 22, 4])
def test_tree_matching_against_all_pairs(cells, monkeypatch):
    monkeypatch.setattr(op8_extract, "CELLS", cells)
    rng = random.Random(1)

    def tree(letter):
        out = [(0, "r", None)]

        def below(depth):
            for _ in range(rng.randrange(0, 4)):
                if depth >= 4 or rng.random() < 0.3:
                    out.append((depth, op8_extract.LEAF, f"{letter}{rng.random()}"))
                else:
                    out.append((depth, rng.choice("ab"), None))
                    below(depth + 1)

        below(1)
        return out

    for _ in range(400):
        shapes, wholes = {}, {}
        a, b = (op8_extract.Blocks(tree(x), shapes, wholes) for x in "xy")
        pairs = op8_extract.Match(a, b).pairs()
        assert len(pairs) == len(set(pairs.values())) == plain_matching(a, b) and all(a.labels[x] == b.labels[y] for y, x in pairs.items())


def test_extraction_by_slots():
    """A block that its path alone doesn't show as template: only the pages of one kind have its slot."""
    list_page = lambda i: f"<body><ul><li>a{i}<li>b{i}</ul><div><p>Join</p><p>list {i}</p><p>x{i}</p></div></body>"
    other = lambda i: f"<body><div><p>own {i}</p></div></body>"
    assert op8_extract.extract([list_page(i) for i in range(5)] + [list_page(9) for _ in range(3)])[0] == "a0\nb0\nlist 0\nx0"
    mixed = [list_page(i) for i in range(9)] + [other(i) for i in range(2)]
    got = op8_extract.extract(mixed)
    assert got[0] == "a0\nb0\nlist 0\nx0" and got[-1] == "own 1"


def test_extraction_of_deep_wide_and_empty_pages(spark):
    deep = ["<b>" * 3000 + "deep", "<div>" * 3000 + "deep</div> after", "<p><table><td>" + "<div>" * 2000 + "<p>deep"]
    assert all("deep" in x for x in op8_extract.extract(deep)) and "after" in op8_extract.extract(deep)[1]
    wide = lambda k: "<body>" + "".join(f"<p class='c{'ab'[i * k % 2]}'>t{i * k}</p>" for i in range(1500))
    assert all(len(x.split("\n")) == 1500 for x in op8_extract.extract([wide(k) for k in (1, 2)]))
    none = spark.createDataFrame([], "page_id long, url string, html string, host int, page int")
    assert op8_extract.query(none).count() == 0
    clash = spark.createDataFrame([(1, "http://a/", "<p class='two\nlines'>x", 1, 2)] * 2, none.schema)
    assert [r["text"] for r in op8_extract.query(clash).collect()] == ["x", "x"]


def test_compaction(spark, tmp_path):
    store = op9_sharding.ShardStore(spark, str(tmp_path / "s"))
    for k in range(3):
        store.append(spark.range(k * 100, k * 100 + 100).repartition(4), rows_a_shard=10)
    before = store.manifest()
    with pytest.raises(op9_sharding.Conflict):
        store.commit({**before, "version": before["version"] - 1}, [])
    store.append(spark.range(0))
    after = store.compact(target=20_000)
    ids = lambda version=None: sorted(r[0] for r in store.read(version).collect())
    assert ids() == list(range(300)) and ids(before["version"]) == list(range(300)) and ids(1) == list(range(100))
    assert len(after["shards"]) < len(before["shards"]) and after["version"] > before["version"]


def test_compaction_beside_other_writers(spark, tmp_path, monkeypatch):
    store, other = (op9_sharding.ShardStore(spark, str(tmp_path / "s")) for _ in range(2))
    store.append(spark.range(100).repartition(4))
    # data that isn't committed yet outlives a compaction and a vacuum
    spark.range(1000, 1010).write.parquet(f"{store.root}/data/late")
    store.compact()
    store.vacuum()
    assert sum(f["bytes"] for f in store._files(f"{store.root}/data/late")) > 0
    # an append between reading and commit of another one, and of a compaction
    store.append(spark.range(100, 200).repartition(4))
    real, once = op9_sharding.ShardStore.commit, []

    def beaten(self, seen, shards, schema=None):
        if self is store and len(once) < 2:
            once.append(1)
            other.append(spark.range(len(once) * 1000, len(once) * 1000 + 5))
        return real(self, seen, shards, schema)

    monkeypatch.setattr(op9_sharding.ShardStore, "commit", beaten)
    store.append(spark.range(200, 300))
    assert len(once) == 2
    once.clear()
    store.compact()
    assert sorted(r[0] for r in store.read().collect()) == sorted([*range(300), *[*range(1000, 1005), *range(2000, 2005)] * 2])
    # what a dead writer left stops writers, not readers, until it is repaired
    n = store.version()
    store.fs.create(store._named(n + 1), False).close()
    assert store.version() == n and store.read().count() == 320
    with pytest.raises(op9_sharding.Conflict):
        store.append(spark.range(1), tries=2)
    store.repair()
    assert store.append(spark.range(1))["version"] == n + 1
    store.vacuum(older_s=0)
    assert store.read().count() == 321 and not store._files(f"{store.root}/data/late")


def test_quality(odd):
    rows = op10_quality.ledger(odd)
    got = {(r["doc_id"], r["n_words"]): r for r in rows.collect()}
    assert got[3, 3000]["n_repeat_words"] == 3000 and got[1, 0]["failures"] == 1 and next(r for k, r in got.items() if k[0] == 4)["failures"] == 0
    assert op10_quality.keep_documents(odd).columns == odd.columns
    assert {r["rule"]: r["fails_alone"] for r in op10_quality.ablations(rows).collect()}["few_words"] == 3
    rng = random.Random(4)
    for _ in range(200):
        w = [rng.choice([b"a", b"b"]) for _ in range(rng.randrange(0, 60))]
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
        assert op10_quality.repeat_words(w) == len(hit)


def test_odd_and_empty_tables(odd):
    none = odd.limit(0)
    assert op2_ctw.query(odd).count() == len(ODD) and op2_ctw.query(none).count() == 0
    assert op6_parity_join.query(odd).count() == len(ODD) and op6_parity_join.query(none).count() == 0
    assert op6_parity_join.keep_one(odd).columns == odd.columns and op6_parity_join.keep_one(odd).count() == len(ODD) - 1
    assert op3_bpe.query(none).count() == op10_quality.ledger(none).count() == op5_mixing.query(none).count() == op9_sharding.query(none).count() == 0
    assert op9_sharding.query(odd).count() == len(ODD)
