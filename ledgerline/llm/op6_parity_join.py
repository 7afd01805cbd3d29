"""Near-duplicate join of word shingles with parity sketches.

A document's set is that of its shingles, as 64-bit hashes (two different shingles of any two texts meet with a chance
of about 2^-64 a pair). Equal sets are one class, and only one document of a class goes on. Sizes are cut into bands of
a ratio of one to the threshold, so linked sets are in one band or in two neighbours, and for the smaller set's band the
symmetric difference of linked sets is at most d. A sketch of that band is the exclusive or of the hashes of the set's
shingles in each of d + 1 + s words, which a hash deals the shingles to: equal shingles cancel out of the difference of
two sketches, and each shingle that is in one set only changes one word, so linked sets agree in s + 1 words at least
(pigeonhole). So each sketch may leave out its s words of the fewest shingles, which say least (all ties stay in): as
agreeing words have equally many, linked sets still share one. Where d is small, the same holds for pairs of words, of
which linked sets share (s + 1) s / 2. Pairs of documents that share a word are tried by bit sketches, where each shingle flips one bit, so that the Hamming distance is at most
the symmetric difference; what is within reach, directly or through others, forms a cluster, which holds all possible links of its members. (Without the sketches, words that unlike documents
share would tie ever more of a growing corpus into one cluster.) Several words of the same documents are tried once, and words of more than GROUP documents not at all: these are of one cluster.
Within it, pairs are tried by longer sketches; pairs within reach are verified by their sets until what is linked is connected.

Clusters are worked on in blocks of BLOCK documents, each with the cluster's same few hub documents; only where that
leaves a cluster in several parts are pairs of blocks compared, all of them: first by sketches of SKETCH_BITS, then by the
sets of the documents that those leave within reach of another part. No task gets more than two blocks.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing; a very long text has
the set of all its shingles; ties at the threshold are links; fewer words than a
shingle are one shingle; a null id has a row with a null component and links with nothing; rows that repeat an id count
as one document with the set of each row, and each row is in the result; an empty table gives an empty result; further
columns come through keep_one() unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, released, slices, small_batches, written
from .components import components

WORDS, PERCENT = 3, 90
BLOCK = 2048
HUBS = 32
REMEMBERED = 200_000
#: Of the bitmap of documents in clusters, which goes to every task; a multiple of 64.
FILTER_BITS = 1 << 23
#: Of a sketch that goes to pairs of blocks.
SKETCH_BITS = 1024
#: Up to this d, keys are of pairs of sketch words.
PAIRED = 10
#: Documents of a key that are tried by sketches.
GROUP = 8192

_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The distinct hashes of all runs of n words of the whole text, sorted."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > REMEMBERED:
        _words.clear()
    known = _words
    try:
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out + np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def edges_of(percent: int) -> tuple[list[int], list[int]]:
    """The least size of each band, and for each the largest symmetric difference of linked sets whose smaller one is in it."""
    starts, most = [1], []
    while starts[-1] < 2**40:
        starts.append(max(starts[-1] + 1, -(-starts[-1] * 100 // percent)))
    for a in starts[1:]:
        most.append((a - 1) * (100 - percent) // percent)
    return starts, most


def sketch_keys(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of the sketch words in the set's own band, as the smaller of two, and in the band below, as the larger."""
    starts, most = edges_of(percent)
    own = int(np.searchsorted(starts, len(s), "right")) - 1
    out = []
    for band in (own, own - 1):
        if band < 0 or not most[band]:
            continue  # no difference: equal sets only, which are one class
        spare = max(2, (most[band] + 1) // 4)
        n = most[band] + 1 + spare
        at = ((s >> np.uint64(33)) % np.uint64(n)).astype(np.int64)
        words = np.zeros(n, np.uint64)
        np.bitwise_xor.at(words, at, s)
        place = np.arange(n, dtype=np.uint64) + (np.uint64(band) << np.uint64(40))
        weight, drop = np.bincount(at, minlength=n), spare
        if most[band] <= PAIRED:
            i, j = np.triu_indices(n, 1)
            place, words, weight, drop = _mix(place[i] + np.uint64(3)) + place[j], _mix(words[i] + np.uint64(3)) + words[j], weight[i] + weight[j], (spare + 1) * spare // 2 - 1
        heavy = weight >= np.sort(weight)[drop]
        out.append(_mix(_mix(place[heavy] + np.uint64(1)) + words[heavy]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def parity(s: np.ndarray, bits: int) -> np.ndarray:
    return np.packbits((np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.uint64)


def fitting(n: int) -> int:
    """Bits of a sketch of n shingles that tell it from others: unlike sets differ in about half of them, linked ones in a quarter of n at most."""
    return 1 << min(13, max(7, (n - 1).bit_length()))


_SET = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("sketch", T.BinaryType())])


def sets(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """id, n, two halves of a digest of the set, and its sketch keys and sketch of fitting bits, left out where the task remembers the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        met: set[bytes] = set()
        for b in slices(batches):
            if len(met) > REMEMBERED:
                met.clear()
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(text, n)
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                low, high = np.frombuffer(digest, np.int64).tolist()
                keys = sketch = None
                if len(s) and i is not None and digest not in met:
                    met.add(digest)
                    keys, sketch = sketch_keys(s, percent).tobytes(), parity(s, fitting(len(s))).tobytes()
                rows.append((i, len(s), low, high, keys, sketch))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=_SET.names)
        _words.clear()  # workers live on, with later stages in them
        met.clear()
        released()

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(run, _SET)


class Links:
    """Union-find over positions."""

    def __init__(self, parts: list[int]) -> None:
        first: dict[int, int] = {}
        self.up = np.array([first.setdefault(p, i) for i, p in enumerate(parts)], np.int64)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def labels(self) -> np.ndarray:
        while (nxt := self.up[self.up]).tolist() != self.up.tolist():
            self.up = nxt
        return self.up


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def connect(ids: list[int], found: list[np.ndarray], parts: list[int], sides: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links that connect all that is linked; sides: compare only documents of different sides."""
    size = np.array([len(s) for s in found])
    reach = int(size.max()) * (100 - percent) // percent
    bits = 64
    while bits < min(8 * (reach + 1), 1 << 15):
        bits *= 2
    sketches = np.stack([parity(s, bits) for s in found])
    links, out = Links(parts), []
    for i in range(len(ids)):
        rest = np.arange(i + 1, len(ids))
        if not len(rest):
            break
        labels = links.labels()
        rest = rest[labels[rest] != links.find(i)]
        if sides is not None:
            rest = rest[sides[rest] != sides[i]]
        low, high = np.minimum(size[rest], size[i]), np.maximum(size[rest], size[i])
        rest = rest[100 * low >= percent * high]
        if not len(rest):
            continue
        # 100 |a & b| >= p |a | b| is (100 + p) |a ^ b| <= (100 - p) (|a| + |b|)
        apart = np.bitwise_count(sketches[rest] ^ sketches[i]).sum(axis=1, dtype=np.int64)
        rest = rest[(100 + percent) * apart <= (100 - percent) * (size[rest] + size[i])]
        for j in rest.tolist():
            a, b = links.find(i), links.find(j)
            if a != b and linked(found[i], found[j], percent):
                links.up[max(a, b)] = min(a, b)
                out.append((ids[i], ids[j]))
    return out


def sets_of(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id, set: of the rows of texts (id, text) whose id wanted has, and few others: a bitmap of fixed size passes them."""
    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    bits = wanted.select(slot.alias("s")).groupBy((F.col("s") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("b")).collect()  # at most FILTER_BITS / 64 rows
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    for r in bits:
        bitmap[r["w"]] = r["b"]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            b = b.filter(pa.array((bitmap[at // 64] >> (at % 64)) & 1 == 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, words).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["id", "set"])
        _words.clear()
        released()

    return texts.select("id", "text", slot.alias("slot")).mapInArrow(digests, "id long, set binary")


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        found = [np.frombuffer(s, np.uint64) for s in b.column("set").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(s) for s in found], pa.int64()), pa.array([parity(s, SKETCH_BITS).tobytes() for s in found], pa.binary())], names=["id", "n", "sketch"])
    released()


def within_reach(g: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The documents of two blocks that one of the other block and another part may be linked with, by sizes and sketches."""
    side, size, part = g["side"].to_numpy(), g["n"].to_numpy(), g["part"].to_numpy()
    sketches = np.stack([np.frombuffer(s, np.uint64) for s in g["sketch"]])
    hit = np.zeros(len(g), bool)
    other = np.flatnonzero(side != side[0])
    for i in np.flatnonzero(side == side[0]).tolist():
        low, high = np.minimum(size[other], size[i]), np.maximum(size[other], size[i])
        rest = other[(100 * low >= percent * high) & (part[other] != part[i])]
        apart = np.bitwise_count(sketches[rest] ^ sketches[i]).sum(axis=1, dtype=np.int64)
        rest = rest[(100 + percent) * apart <= (100 - percent) * (size[rest] + size[i])]
        hit[rest] = True
        hit[i] |= len(rest) > 0
    return g.loc[hit, ["component", "lo", "hi", "id", "part", "side"]]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, id), sorted: rows (g, id, a) of the documents of each key that several have. g is a number for the set of documents, that two keys share; should
    two sets agree in it, they are tried together. It is NULL for keys of more than GROUP; a is the least id."""
    met: set[int] = set()

    def several(key: np.ndarray, i: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1])  # a set may come from two tasks
        key, i = key[new], i[new]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        m = np.diff(np.append(starts, len(key)))
        some = np.repeat(m > 1, m)
        i, m = i[some], m[m > 1]
        starts = np.cumsum(m) - m
        g = _mix(np.add.reduceat(_mix(i.view(np.uint64)), starts) + m.astype(np.uint64)).view(np.int64) if len(m) else np.zeros(0, np.int64)
        first = np.zeros(len(m), bool)
        first[np.unique(g, return_index=True)[1]] = True
        for k in np.flatnonzero(first).tolist():
            first[k] = int(g[k]) not in met
        if len(met) > REMEMBERED:
            met.clear()
        met.update(g[first].tolist())
        rows = np.repeat(first, m)
        g, wide, a = (np.repeat(x, m)[rows] for x in (g, m > GROUP, i[starts]))
        return pa.RecordBatch.from_arrays([pa.array(g, mask=wide), pa.array(i[rows]), pa.array(a)], names=["g", "id", "a"])

    key = i = np.zeros(0, np.int64)
    for b in batches:
        if not b.num_rows:
            continue
        key, i = np.concatenate([key, b.column(0).to_numpy()]), np.concatenate([i, b.column(1).to_numpy()])
        at = int(np.searchsorted(key, key[-1]))
        if at:
            yield several(key[:at], i[:at])
            key, i = key[at:].copy(), i[at:].copy()
    if len(key):
        yield several(key, i)
    met.clear()
    released()


def within(ids: list[int], sizes: list[int], sketches: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Pairs that connect what sizes and sketches leave within reach, the smaller id first; sketches are folded to the length of the shortest."""
    short = min(map(len, sketches))
    links, out = Links(list(range(len(ids)))), []

    def tie(i: int, j: int) -> None:
        a, b = links.find(i), links.find(j)
        if a != b:
            links.up[max(a, b)] = min(a, b)
            out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))

    folded = [np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, short // 8), axis=0) for s in sketches]
    if len(ids) <= 16:
        bits = [int.from_bytes(x.tobytes(), "little") for x in folded]
        for i in range(len(ids)):
            for j in range(i + 1, len(ids)):
                # 100 |a & b| >= p |a | b| is (100 + p) |a ^ b| <= (100 - p) (|a| + |b|)
                if 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j]) and (100 + percent) * (bits[i] ^ bits[j]).bit_count() <= (100 - percent) * (sizes[i] + sizes[j]):
                    tie(i, j)
        return out
    table, size = np.stack(folded), np.array(sizes)
    for i in range(len(ids)):
        labels = links.labels()
        rest = np.arange(i + 1, len(ids))
        rest = rest[labels[rest] != labels[i]]
        rest = rest[100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])]
        apart = np.bitwise_count(table[rest] ^ table[i]).sum(axis=1, dtype=np.int64)
        for j in rest[(100 + percent) * apart <= (100 - percent) * (size[rest] + size[i])].tolist():
            tie(i, j)
    return out


def tried(rows: DataFrame, percent: int) -> DataFrame:
    """a, b of rows (g, id, n, sketch), which are of a group each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def pairs() -> list[tuple[int, int]]:
            return within(*map(list, zip(*held, strict=True)), percent) if len(held) > 1 else []

        for b in slices(batches):
            found = []
            for g, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != now:
                    found += pairs()
                    now, held = g, []
                held.append(row)
            a = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])
        a = np.array(pairs(), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])
        released()

    return rows.select("g", "id", "n", "sketch").repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def linked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id."""
    with small_batches(docs.sparkSession):
        every = written(sets(docs, id_col, text_col, words, percent))
    classes = every.filter((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("low", "high").agg(F.min("id").alias("rep"), F.max("n").alias("n"))
    classes = written(classes)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys = [np.frombuffer(k, np.int64) for k in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *keys])), pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(k) for k in keys]).astype(np.int64))], names=["key", "id"])
        released()

    # classes go by half of their digest here; should two agree in it, they share a cluster
    keyed = every.filter(F.octet_length("keys") > 0).select("low", "keys").mapInArrow(unpack, "key long, id long")
    shared = written(keyed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(grouped, "g long, id long, a long"))
    sketches = every.filter("sketch is not null").select(F.col("low").alias("id"), "n", "sketch").dropDuplicates(["id"])
    near = tried(shared.filter("g is not null").select("g", "id").distinct().join(sketches, "id"), percent)
    near = cut(near.unionByName(shared.filter("g is null and id <> a").select("a", F.col("id").alias("b"))).distinct())
    clusters = cut(components(near).join(classes.select(F.col("low").alias("id"), "rep"), "id").select(F.col("rep").alias("id"), "component"))
    sized = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    members = clusters.join(sized, "component").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # hubs: in a cluster of several blocks, a hash takes about HUBS of its members into every block
    hub = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("id", F.lit(7)), F.greatest(F.lit(1), (F.col("m") / HUBS).cast("long"))) == 0)
    blocks = written(members.withColumn("ats", F.when(hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))).select("id", "component", "blocks", "block", "ats"))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("id is not null")
    task = "a long, b long"

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["id", "set"])
        found = [np.frombuffer(s, np.uint64) for s in g["set"]]
        sides = g["side"].to_numpy() if "side" in g else None
        links = connect(g["id"].tolist(), found, g["part"].tolist(), sides, percent)
        if len(g) > BLOCK // 4:  # not after each of many small groups
            del found, g
            released()
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    placed = blocks.select("id", "component", F.explode("ats").alias("at"))
    first = sets_of(texts, blocks, words).join(placed, "id").withColumn("part", F.col("id")).groupBy("component", "at").applyInPandas(work, task)
    with small_batches(docs.sparkSession):
        links = cut(first)
    # clusters of several blocks that are still in parts: all pairs of blocks, by sketches of one size, then by the sets of those within reach
    parted = blocks.filter("blocks > 1")
    if parted.take(1):
        part = components(links)
        state = written(parted.join(part.withColumnRenamed("component", "p"), "id", "left").withColumn("part", F.coalesce("p", "id")).select("id", "component", "blocks", "block", "part"))
        open_ = state.groupBy("component").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x <> y").select("component")
        state = written(state.join(open_, "component", "left_semi"))
        if state.take(1):
            with small_batches(docs.sparkSession):
                own = written(sets_of(texts, state, words).join(state.select("id"), "id", "left_semi"))
            mine, other = F.col("block"), F.col("o")
            pairs = state.join(own.mapInArrow(_sketched, "id long, n long, sketch binary"), "id").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter(mine != other)
            pairs = pairs.select("id", "n", "sketch", "component", "part", F.least(mine, other).alias("lo"), F.greatest(mine, other).alias("hi"), F.col("block").alias("side"))
            by = ["component", "lo", "hi"]
            near = written(pairs.groupBy(*by).applyInPandas(lambda g: within_reach(g, percent), "component long, lo int, hi int, id long, part long, side int"))
            links = cut(links.unionByName(near.join(own, "id").groupBy(*by).applyInPandas(work, task)))
    # repeated ids with several sets tie the classes of those sets together
    groups = every.filter((F.col("n") > 0) & F.col("id").isNotNull()).join(classes.select("low", "high", "rep"), ["low", "high"]).select(F.col("rep").alias("a"), F.col("id").alias("b"))
    part = components(links.unionByName(groups.filter("a <> b").distinct()))
    out = every.select("id", "n").join(part, "id", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The document of the least id of each component, once, and all without an id; the columns of docs. Of rows that share the id, the one of the
    least text stays, of equal texts that of the least hash of all columns."""
    found = linked_documents(docs, words=words, percent=percent)
    gone = found.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    twice = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id").join(gone, "doc_id", "left_anti")
    odd = written(gone.withColumn("gone", F.lit(True)).unionByName(twice.withColumn("gone", F.lit(False))))
    once = docs.join(odd.select("doc_id"), "doc_id", "left_anti")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    same = docs.join(odd.filter("not gone").select("doc_id"), "doc_id", "left_semi").select("doc_id", row.alias("row"), F.struct(F.col("text"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))).alias("at"))
    first = same.groupBy("doc_id").agg(F.min_by("row", "at").alias("row")).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
    return once.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(first)


def query(docs: DataFrame) -> DataFrame:
    return linked_documents(docs)


SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(doc_id, c) as (select doc_id, doc_id from d union select e.b, r.c from r join e on e.a = r.doc_id where r.c < e.b)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.c)::bigint as component_id
from d left join n using (doc_id) join r using (doc_id) group by all
"""
