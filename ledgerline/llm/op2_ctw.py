"""Language-model scores by context-tree weighting over bytes.

Every byte is eight binary decisions, one for each node of its bit tree; each node has a context tree over the DEPTH bytes
before it. A context holds the Krichevsky-Trofimov estimate of its counts and the weighted probability
Pw = (Pe + product of the children's Pw) / 2; the model is frozen after training, and a bit's probability is the mixture
along its path of contexts. A context that training has not met has no say, and the one above it answers in its place.
Before each byte and after the last, one more decision says whether the text ends there, weighted in the same way over the
byte before it, so that the probabilities of all texts sum to one.

Documents are dealt into blocks of about BLOCK_BYTES by a hash. A block counts its distinct (context, byte) grams and its
words, and sends them compressed to shards, contexts by their last SHARED bytes and words by their hash. A shard merges
the counts of all blocks, weights its part of the tree and sends each block its keys back with their values; the levels
above the shards are joined on the driver: one row for each SHARED bytes met, 256^SHARED at most whatever the input (about
18,000 in texts of four languages). The block then scores its texts by those keys. Shards are as many as SHARDS_A_ROOT
times the root of the number of blocks, so messages grow with the power 1.5 of the input and a shard's lists with its
root. Nothing that grows with the corpus is broadcast.

Defined cases: a null text counts as empty and has the end token only; a very long text is scored whole, by one task; a null
id counts as training; repeated rows, ties of any kind among them, count each time; an empty table gives an empty result;
further columns are ignored. Without training documents all counts are 0 and every decision has probability 1/2.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out

DEPTH = 5
BLOCK_BYTES = 24 * 2**20
#: Contexts with the same last bytes, so many, share a shard; at least one less than DEPTH, at most 3.
SHARED = 3
#: Shards by the root of the number of blocks.
SHARDS_A_ROOT = 4
PIECE = 2**21

_SENT = "block long, kind string, shard int, keys binary, counts binary"
_ANSWER = "block long, kind string, shard int, keys binary, values binary"
_LN2 = math.log(2)
_SMALL = np.array([math.lgamma(i / 2) if i else 0.0 for i in range(2**14)])


def lgamma_halves(twice: np.ndarray) -> np.ndarray:
    """log gamma of twice / 2, for whole numbers."""
    x = np.maximum(twice, 1) / 2.0
    far = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(twice < len(_SMALL), _SMALL[np.minimum(twice, len(_SMALL) - 1)], far)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return lgamma_halves(2 * n0 + 1) + lgamma_halves(2 * n1 + 1) - lgamma_halves(2 * (n0 + n1) + 2) - math.log(math.pi)


class Level:
    """The nodes of one depth over sorted (context, byte) keys, byte last: for each row and bit, the node's counts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, below: np.ndarray | None) -> None:
        """below: for each row and bit, sums of the children's log Pw; None at the full depth."""
        m = len(keys)
        self.weight, self.kt, self.seen, self.up = np.zeros((m, 8)), np.zeros((m, 8)), np.zeros((m, 8), bool), np.zeros((m, 8))
        for k in range(8):
            node = keys >> np.uint64(8 - k)
            start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if m else np.zeros(0, np.int64)
            if not m:
                continue
            run = np.repeat(np.arange(len(start)), np.diff(np.append(start, m)))
            bit = ((keys >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)
            total, ones = np.add.reduceat(n, start), np.add.reduceat(n * bit, start)
            pe = log_kt(total - ones, ones)
            if below is None:
                pw, alpha = pe, np.ones(len(start))
            else:
                pw = np.logaddexp(pe, np.add.reduceat(below[:, k], start)) - _LN2
                alpha = np.exp(pe - _LN2 - pw)
            self.up[start, k] = np.where(total > 0, pw, 0)
            self.weight[:, k], self.seen[:, k] = alpha[run], total[run] > 0
            self.kt[:, k] = (np.where(bit == 1, ones[run], (total - ones)[run]) + 0.5) / (total[run] + 1)

    def down(self, state: np.ndarray) -> np.ndarray:
        """state: (rows, 8, 3) with the mixture so far, the weight left, the last estimate met."""
        mixed, left, last = state[..., 0], state[..., 1], state[..., 2]
        out = state.copy()
        out[..., 0] = np.where(self.seen, mixed + left * self.weight * self.kt, mixed)
        out[..., 1] = np.where(self.seen, left * (1 - self.weight), left)
        out[..., 2] = np.where(self.seen, self.kt, last)
        return out


def shorter(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys with the oldest byte of the context dropped, distinct, and where each row's is."""
    return np.unique(((keys >> np.uint64(16)) << np.uint64(8)) | (keys & np.uint64(255)), return_inverse=True)


def summed(inverse: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    if values.ndim == 1:
        return np.bincount(inverse, values, size).astype(np.int64)
    return np.stack([np.bincount(inverse, values[:, k], size) for k in range(values.shape[1])], axis=1)


def climb(keys: np.ndarray, n: np.ndarray, below: np.ndarray | None, steps: int) -> tuple[list[Level], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Levels from the deepest up, the row of the level above for each row, and keys, counts and sums for the next level."""
    levels, inverses = [], []
    for _ in range(steps):
        level = Level(keys, n, below)
        keys, inverse = shorter(keys)
        n, below = summed(inverse, n, len(keys)), summed(inverse, level.up, len(keys))
        levels.append(level)
        inverses.append(inverse)
    return levels, inverses, keys, n, below


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts with DEPTH zeros before each, and where the bytes of the texts are."""
    gap = b"\0" * DEPTH
    n = np.array([len(t) for t in texts], np.int64)
    at = np.arange(int(n.sum())) + np.repeat(np.arange(1, len(texts) + 1) * DEPTH, n)
    return np.frombuffer(gap + gap.join(texts), np.uint8), at


def gram_keys(texts: list[bytes]) -> np.ndarray:
    """For each byte of the texts in turn: the byte before it, the one before that and so on, then itself; zeros before a text."""
    buf, at = _buffer(texts)
    whole = buf.astype(np.uint64)
    out = whole.copy()
    for d in range(1, DEPTH + 1):
        out[d:] |= whole[:-d] << np.uint64(8 * (DEPTH + 1 - d))
    return out[at]


def _pieces(texts: list[bytes]):
    """Runs of texts of about PIECE bytes; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= PIECE:
            yield run
            run, size = [], 0
    if run:
        yield run


def distinct_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for run in _pieces(texts):
        k, c = np.unique(gram_keys(run), return_counts=True)
        keys, inverse = np.unique(np.concatenate([keys, k]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([counts, c]), len(keys)).astype(np.int64)
    return keys, counts


def gram_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the SHARED last bytes of the context."""
    tail = keys >> np.uint64(8 * (DEPTH + 1 - SHARED))
    return ((tail * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % shards


def word_shard(word: bytes, shards: int) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(word) % shards


def _pack(a: np.ndarray) -> bytes:
    """Planes of bytes, compressed."""
    import zstandard

    return zstandard.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 3)


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    import zstandard

    raw, size = np.frombuffer(zstandard.decompress(blob), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind)[:, 0] if len(raw) else np.zeros(0, kind)


def _texts(rows: pa.Table) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in rows.column("text").to_pylist()]


def ends_of(texts: list[bytes]) -> np.ndarray:
    """(2, 256): by the byte before, 0 at the start of a text, how often a byte followed and how often the end."""
    out = np.zeros((2, 256), np.int64)
    for run in _pieces(texts):
        buf, at = _buffer(run)
        out[0] += np.bincount(buf[at - 1], minlength=256)
        out[1] += np.bincount([t[-1] if t else 0 for t in run], minlength=256)
    return out


def _send(shards: int):
    import zstandard

    def run(rows: pa.Table) -> pa.Table:
        block, held = rows.column("block")[0].as_py(), rows.column("held_out").to_pylist()
        texts, out = _texts(rows), []
        train = [t for t, h in zip(texts, held, strict=True) if not h]
        rest = [t for t, h in zip(texts, held, strict=True) if h]
        known, n = distinct_grams(train)
        keys = np.union1d(known, distinct_grams(rest)[0])
        counts = np.zeros(len(keys), np.int64)
        counts[np.searchsorted(keys, known)] = n
        where = gram_shard(keys, shards)
        for s in np.unique(where).tolist():
            at = np.flatnonzero(where == s)
            out.append((block, "gram", s, _pack(np.diff(keys[at], prepend=np.uint64(0))), _pack(counts[at])))
        words: Counter[bytes] = Counter()
        for t in train:
            words.update(t.lower().split())
        of_shard: list[list[bytes]] = [[] for _ in range(shards)]
        for w in set(words).union(*(t.lower().split() for t in rest)):
            of_shard[word_shard(w, shards)].append(w)
        for s, own in enumerate(of_shard):
            if own:
                out.append((block, "word", s, zstandard.compress(b"\n".join(own), 3), _pack(np.array([words[w] for w in own], np.int64))))
        out.append((block, "end", 0, b"", _pack(ends_of(train).ravel())))
        return _table(out, _SENT)

    return run


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    fields = [x.split() for x in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table({n: pa.array(c, _ARROW[k]) for (n, k), c in zip(fields, columns, strict=True)})


def _merge_grams(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    asked = [np.cumsum(_unpack(k, "<u8"), dtype=np.uint64) for k in rows.column("keys").to_pylist()]
    keys, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    n = np.bincount(inverse, np.concatenate([_unpack(c, "<i8") for c in rows.column("counts").to_pylist()]), len(keys)).astype(np.int64)
    return asked, keys, n


_UP = "key long, n long, " + ", ".join(f"v{k} double" for k in range(8))


def upward(rows: pa.Table) -> pa.Table:
    """What a shard of contexts gives to the top levels; or a shard of words: under key -1 its distinct words and tokens."""
    kind = rows.column("kind")[0].as_py()
    if kind == "gram":
        _, keys, n = _merge_grams(rows)
        _, _, keys, n, below = climb(keys, n, None, DEPTH + 1 - SHARED)
        return _table([(int(k), int(c), *map(float, v)) for k, c, v in zip(keys, n, below, strict=True)], _UP)
    counts, _ = _merge_words(rows)
    values = np.fromiter(counts.values(), np.int64, len(counts))
    return _table([(-1, int(values.sum()), float((values > 0).sum()), *[0.0] * 7)], _UP)


def _merge_words(rows: pa.Table) -> tuple[dict[bytes, int], list[list[bytes]]]:
    import zstandard

    counts: dict[bytes, int] = {}
    asked = []
    for k, c in zip(rows.column("keys").to_pylist(), rows.column("counts").to_pylist(), strict=True):
        words = zstandard.decompress(k).split(b"\n") if k else [b""]
        asked.append(words)
        for w, n in zip(words, _unpack(c, "<i8").tolist(), strict=True):
            counts[w] = counts.get(w, 0) + n
    return counts, asked


def top_levels(keys: np.ndarray, n: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The levels above the shards, over rows (last bytes, byte): sorted keys and their states."""
    levels, inverses, root, total, sums = climb(keys, n, below, SHARED - 1)
    start = np.zeros((len(root), 8, 3))
    start[..., 1], start[..., 2] = 1.0, 0.5
    state = Level(root, total, sums).down(start)
    for level, inverse in zip(reversed(levels), reversed(inverses), strict=True):
        state = level.down(state[inverse])
    return keys, state


def end_costs(n: np.ndarray) -> np.ndarray:
    """n as of ends_of; log10 of the probability that a byte follows, or the end, by context-tree weighting over one byte."""
    pe = log_kt(n[0], n[1])
    all_ = n.sum(axis=1)
    root = log_kt(*all_)
    alpha = np.exp(root - np.logaddexp(root, pe.sum()))
    upper, own = (all_ + 0.5) / (all_.sum() + 1), (n + 0.5) / (n.sum(axis=0) + 1)
    # a byte that training has not met before anything leaves it to the root
    return np.log10(np.where(n.sum(axis=0) > 0, alpha * upper[:, None] + (1 - alpha) * own, upper[:, None]))


def _answers(top: tuple[np.ndarray, np.ndarray]):
    """To each block its keys or words back, as they came, with their values."""

    def run(rows: pa.Table) -> pa.Table:
        kind, shard = rows.column("kind")[0].as_py(), rows.column("shard")[0].as_py()
        blocks, sent = rows.column("block").to_pylist(), rows.column("keys").to_pylist()
        if kind == "gram":
            asked, keys, n = _merge_grams(rows)
            levels, inverses, upper, _, _ = climb(keys, n, None, DEPTH + 1 - SHARED)
            state = top[1][np.searchsorted(top[0], upper)]
            for level, inverse in zip(reversed(levels), reversed(inverses), strict=True):
                state = level.down(state[inverse])
            score = np.log10(state[..., 0] + state[..., 1] * state[..., 2]).sum(axis=1)
            return _table([(b, kind, shard, k, _pack(score[np.searchsorted(keys, a)])) for b, k, a in zip(blocks, sent, asked, strict=True)], _ANSWER)
        counts, words = _merge_words(rows)
        return _table([(b, kind, shard, k, _pack(np.array([counts[w] for w in ws], np.int64))) for b, k, ws in zip(blocks, sent, words, strict=True)], _ANSWER)

    return run


def looked_up(asked: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values of the asked keys, all of which the sorted keys hold. Sorted in stretches with their places packed below them, so
    that the search meets its keys in order; keys have at most 48 bits."""
    out = np.empty(len(asked))
    for i in range(0, len(asked), 1 << 16):
        part = asked[i : i + (1 << 16)]
        packed = np.sort((part << np.uint64(16)) | np.arange(len(part), dtype=np.uint64))
        out[i + (packed & np.uint64(0xFFFF)).astype(np.int64)] = values[np.searchsorted(keys, packed >> np.uint64(16))]
    return out


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


def _score(total: int, distinct: int, ends: np.ndarray):
    import zstandard

    floor = math.log10(total + 0.1 * (distinct + 1))
    go, stop = end_costs(ends)

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table([], _SCORE)
        keys, values, counts = [], [], {b"": int(ends[1].sum())}
        for kind, k, v in zip(*(answers.column(c).to_pylist() for c in ("kind", "keys", "values")), strict=True):
            if kind == "gram":
                keys.append(np.cumsum(_unpack(k, "<u8"), dtype=np.uint64))
                values.append(_unpack(v, "<f8"))
            else:
                counts.update(zip(zstandard.decompress(k).split(b"\n"), _unpack(v, "<i8").tolist(), strict=True))
        keys, values = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0), *values])
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        texts, scores, n_tokens, n_known, base = _texts(rows), [], [], [], []
        for run_ in _pieces(texts):
            buf, at = _buffer(run_)
            got = np.cumsum(np.concatenate([[0.0], looked_up(gram_keys(run_), keys, values) + go[buf[at - 1]]]))
            scores += (np.diff(got[np.cumsum([len(t) for t in run_])], prepend=0.0) + stop[[t[-1] if t else 0 for t in run_]]).tolist()
            tokens = [[*t.lower().split(), b""] for t in run_]
            c = np.fromiter((n for ws in tokens for n in map(counts.__getitem__, ws)), np.int64)
            starts = np.cumsum([0, *(len(ws) for ws in tokens[:-1])])
            n_tokens += map(len, tokens)
            n_known += np.add.reduceat((c > 0).astype(np.int64), starts).tolist()
            base += np.add.reduceat(np.log10(c + 0.1) - floor, starts).tolist()
        ids, held = rows.column("doc_id").to_pylist(), rows.column("held_out").to_pylist()
        return _table([(i, h, n, k, total, b, s, len(t)) for i, h, n, k, b, s, t in zip(ids, held, n_tokens, n_known, base, scores, texts, strict=True)], _SCORE)

    return run


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: counts, the unigram base and the model's log10 probability of the text, its end included."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    shards = math.ceil(SHARDS_A_ROOT * math.sqrt(blocks))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    sent = cut(dealt.groupBy("block").applyInArrow(_send(shards), _SENT))
    ends = np.zeros((2, 256), np.int64)
    for r in sent.filter("kind = 'end'").select("counts").toLocalIterator():
        ends += _unpack(bytes(r[0]), "<i8").reshape(2, 256)
    asked = sent.filter("kind <> 'end'")
    up = asked.groupBy("kind", "shard").applyInArrow(upward, _UP).groupBy("key").agg(F.sum("n").alias("n"), *(F.sum(f"v{k}").alias(f"v{k}") for k in range(8))).toPandas()
    words = up[up["key"] == -1]
    total = int(words["n"].sum()) + int(ends[1].sum())
    distinct = int(words["v0"].sum()) + bool(ends[1].any())
    top = up[up["key"] >= 0].sort_values("key")
    states = top_levels(top["key"].to_numpy(np.uint64), top["n"].to_numpy(np.int64), top[[f"v{k}" for k in range(8)]].to_numpy(float)) if len(top) else (np.zeros(0, np.uint64), np.zeros((0, 8, 3)))
    answers = asked.groupBy("kind", "shard").applyInArrow(_answers(states), _ANSWER)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(total, distinct, ends), _SCORE)


def query(docs: DataFrame) -> DataFrame:
    bits = (-F.col("score") * math.log2(10)) / F.col("n_bytes")
    return scores(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", F.when(F.col("n_bytes") > 0, bits).alias("bits_per_byte"))
