"""Substring deduplication by prefix-partitioned suffix trees over words.

Every word starts a suffix. Suffixes are dealt into groups by their first PREFIX words, or by all of the window's words where
a prefix is so common that its group wouldn't fit in memory, and each group builds its part of the suffix tree, down to the window:
its suffixes sorted by what follows the prefix, and the nodes at which two or more of them still agree. A node as deep as the
window is a repeat; the least document below it keeps its words, and every other word that such a node covers goes. Neighbouring
repeats of a document join to its maximal ones, which are the spans in the result.

Two rounds, both by messages between blocks of documents and groups of suffixes:
1. each block names its distinct prefixes to their groups, which answer with a bit for each: whether another block has it, and
   whether it is common. A suffix whose prefix is in no other block hangs alone there, above every deep node, and stays at home;
2. the remaining suffixes go to their groups, alike ones of a block as one, with the least document that has them. The groups
   build their subtrees and answer with the suffixes of which a smaller document lies below the same deep node.
What occurs within one block is settled there. A passage that all documents share is one suffix for each block and window word, so
neither hot passages nor groups of copies make hot tasks. Messages grow with the words; empty ones aren't sent. Documents are
shuffled once, to blocks of about BLOCK_BYTES; that exchange serves both rounds and the result.

Words enter as 64-bit fingerprints (of random values for bytes, at their places), prefixes as 64 bits and the rest of a window as 48
bits more. Defined cases: null or empty texts and texts shorter than the window lose nothing; a null id counts as larger than all
others; rows that share an id don't touch each other, repeated rows neither; very long texts are taken whole; an empty table
gives an empty result; further columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a repeat, and of the prefix by which suffixes are dealt.
WINDOW, PREFIX = 13, 8
#: Text of a block; suffixes of a prefix from which on they are dealt by the whole window; suffixes of a group.
BLOCK_BYTES, COMMON, GROUP = 2 << 20, 1 << 16, 1 << 22

_LAST = 2**63 - 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 3
_OF_BYTE = np.random.default_rng(11).integers(0, 2**64, 256, np.uint64)


@cache
def _powers(exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """2^exponent powers of the base and of its inverse, modulo 2^64."""
    both = []
    for b in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.ones(1, np.uint64)
        while len(p) < 1 << exponent:
            p = np.concatenate([p, p * np.uint64(pow(b, len(p), 2**64))])
        both.append(p)
    return both[0], both[1]


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * np.uint64(0x9FB21C651E98DF25) + (y ^ np.uint64(0x632BE59BD9B4E019))
    z ^= z >> np.uint64(31)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(29)
    return z


def _spans(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of n words from each word on; those that reach beyond the end are missing."""
    made, at = None, 0
    for k in reversed(range(n.bit_length())):
        if n >> k & 1:
            part = h
            for i in range(k):
                part = _mixed(part[: -(1 << i)], part[1 << i :]) if len(part) > 1 << i else part[:0]
            part = part[at:]
            m = len(part) if made is None else min(len(made), len(part))
            made = part[:m] if made is None else _mixed(made[:m], part[:m])
            at += 1 << k
    return made


def planes(x: np.ndarray, width: int) -> bytes:
    """The lowest bytes of the values, all first bytes first, so that the shuffle's compression sees equal high bytes side by side."""
    return x.astype("<i8" if x.dtype == np.int64 else "<u8").view(np.uint8).reshape(len(x), 8)[:, :width].T.tobytes()


def values(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    if raw:
        out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


class Block:
    """Documents with their words and the suffixes that are as long as the window."""

    def __init__(self, ids: list[int | None], texts: list[bytes], window: int, prefix: int) -> None:
        self.ids = np.array([_LAST if i is None else i for i in ids], np.int64)
        self.raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        space = _SPACE[self.raw]
        before = np.insert(space[:-1], 0, True) if len(space) else space
        self.begin, self.end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.doc = np.searchsorted(np.cumsum(sizes), self.begin, side="right")
        self.n_words = np.bincount(self.doc, minlength=len(texts))
        up, down = (p[: len(self.raw)] for p in _powers(max(1, len(self.raw) - 1).bit_length()))
        sums = np.insert(np.cumsum(_OF_BYTE[self.raw] * up), 0, 0)
        word = _mixed((sums[self.end] - sums[self.begin]) * down[self.begin], (self.end - self.begin).astype(np.uint64))
        self.window = window
        n = max(0, len(word) - window + 1)
        self.at = np.flatnonzero(self.doc[:n] == self.doc[window - 1 :])
        self.prefix = _spans(word, prefix)[self.at]
        rest = _spans(word[prefix:], window - prefix)[self.at] & np.uint64(2**48 - 1)
        # suffixes by what they say; those that agree down to the window are one
        order = np.lexsort((rest, self.prefix))
        p, r = self.prefix[order], rest[order]
        new = np.ones(len(order), bool)
        new[1:] = (p[1:] != p[:-1]) | (r[1:] != r[:-1])
        first = np.flatnonzero(new)
        self.one = np.empty(len(order), np.int64)
        self.one[order] = np.cumsum(new) - 1
        self.prefixes, self.rests = p[first], r[first]
        self.least = np.minimum.reduceat(self.ids[self.doc[self.at[order]]], first) if len(first) else np.zeros(0, np.int64)
        # distinct prefixes, and how many suffixes each has
        apart = np.ones(len(first), bool)
        apart[1:] = self.prefixes[1:] != self.prefixes[:-1]
        self.group = np.cumsum(apart) - 1
        self.named = self.prefixes[apart]
        self.sizes = np.bincount(self.group, minlength=len(self.named))

    def dealt(self, keys: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each group the places of the keys that belong there; keys in a group stay in order."""
        to = _group_of(keys, groups)
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.diff(to[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            yield int(to[part[0]]), part


def _group_of(keys: np.ndarray, groups: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)


def _block(t: pa.Table, window: int, prefix: int) -> Block:
    return Block(t.column("doc_id").to_pylist(), [x or b"" for x in t.column("text").cast(pa.binary()).to_pylist()], window, prefix)


_NAMES = pa.schema([("to", pa.int64()), ("block", pa.int64()), ("names", pa.binary()), ("common", pa.binary())])
_SENT = pa.schema([("to", pa.int64()), ("block", pa.int64()), ("prefixes", pa.binary()), ("rests", pa.binary()), ("least", pa.binary()), ("ordinals", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("kept", pa.string())])


def _ddl(s: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {'binary' if f.type == pa.binary() else 'string' if f.type == pa.string() else 'long' if f.type == pa.int64() else 'array<struct<start: bigint, length: bigint>>'}" for f in s)


def _name_prefixes(window: int, prefix: int, groups: int) -> Callable:
    """Round 1, a block: the 32 low bits of its distinct prefixes to their groups, and the sizes of those with several suffixes."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        b, out = _block(t, window, prefix), []
        low = b.named & np.uint64(2**32 - 1)
        order = np.argsort(low, kind="stable")
        for to, part in b.dealt(b.named[order], groups):
            at = order[part]
            more = np.flatnonzero(b.sizes[at] >= 8)
            out.append({"to": to, "block": key[0].as_py(), "names": planes(low[at], 4), "common": planes(more.astype(np.uint64), 4) + planes(b.sizes[at][more].astype(np.uint64), 4)})
        return pa.Table.from_pylist(out, _NAMES)

    return run


def _compare_prefixes(key: tuple, t: pa.Table) -> pa.Table:
    """Round 1, a group: for each block and prefix a bit whether another block has it, and one whether it is common."""
    names = [values(x, 4) for x in t.column("names").to_pylist()]
    _, which = np.unique(np.concatenate(names), return_inverse=True)
    size, blocks, at = np.ones(len(which), np.int64), np.bincount(which), 0
    for x, raw in zip(names, t.column("common").to_pylist(), strict=True):
        half = len(raw) // 2
        size[at + values(raw[:half], 4).astype(np.int64)] = values(raw[half:], 4).astype(np.int64)
        at += len(x)
    common = np.bincount(which, weights=size) > COMMON
    cuts = np.cumsum([len(x) for x in names])[:-1]
    bits = [[np.packbits(y).tobytes() if y.any() else b"" for y in np.split(flag[which], cuts)] for flag in (blocks > 1, common)]
    return pa.Table.from_arrays([t.column("to"), t.column("block"), pa.array(bits[0], pa.binary()), pa.array(bits[1], pa.binary())], schema=_NAMES)


def _send_suffixes(window: int, prefix: int, groups: int) -> Callable:
    """Round 2, a block: the suffixes whose prefix others have, to the group of the prefix, or of the window where it is common."""

    def run(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
        b, out = _block(t, window, prefix), []
        told = {to: (n, c) for to, n, c in zip(*(answers.column(x).to_pylist() for x in ("to", "names", "common")), strict=True)}
        shared, common = np.zeros(len(b.named), bool), np.zeros(len(b.named), bool)
        order = np.argsort(b.named & np.uint64(2**32 - 1), kind="stable")
        for to, part in b.dealt(b.named[order], groups):
            for flag, bits in zip((shared, common), told[to], strict=True):
                if bits:
                    flag[order[part]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(part)).astype(bool)
        send = np.flatnonzero(shared[b.group])
        keys = np.where(common[b.group[send]], _mixed(b.prefixes[send], b.rests[send]), b.prefixes[send])
        for to, part in b.dealt(keys, groups):
            at = send[part]
            out.append({"to": to, "block": key[0].as_py(), "prefixes": planes(b.prefixes[at], 8), "rests": planes(b.rests[at], 6), "least": planes(b.least[at], 8), "ordinals": planes(at.astype(np.uint64), 4)})
        return pa.Table.from_pylist(out, _SENT)

    return run


def _grow_trees(key: tuple, t: pa.Table) -> pa.Table:
    """Round 2, a group: its subtrees; the suffixes below a node as deep as the window that a smaller document shares.

    Sorted suffixes with the depth to which each agrees with the one before are the tree: a node is a stretch of suffixes
    that agree to its depth. The deep nodes are the stretches that agree down to the window."""
    p, r, least, ordinals = (np.concatenate([values(x, w) for x in t.column(c).to_pylist()]) for c, w in (("prefixes", 8), ("rests", 6), ("least", 8), ("ordinals", 4)))
    least = least.view(np.int64)
    order = np.lexsort((r, p))
    deeper = np.zeros(len(order), bool)  # agrees with the suffix before it down to the window
    deeper[1:] = (p[order][1:] == p[order][:-1]) & (r[order][1:] == r[order][:-1])
    nodes = np.flatnonzero(~deeper)
    under = np.cumsum(~deeper) - 1
    below = np.empty(len(order), np.int64)
    below[order] = np.minimum.reduceat(least[order], nodes)[under]
    lost = below < least
    out, at = [], 0
    for block, raw in zip(t.column("block").to_pylist(), t.column("ordinals").to_pylist(), strict=True):
        n = len(raw) // 4
        mine = ordinals[at : at + n][lost[at : at + n]]
        if len(mine):
            out.append({"to": key[0].as_py(), "block": block, "names": planes(mine, 4), "common": None})
        at += n
    return pa.Table.from_pylist(out, _NAMES)


def _cut_out(window: int, prefix: int) -> Callable:
    """A block and the suffixes that smaller documents of other blocks have: its documents without the covered words."""

    def run(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
        b = _block(t, window, prefix)
        elsewhere = np.zeros(len(b.prefixes), bool)
        for raw in answers.column("names").to_pylist():
            elsewhere[values(raw, 4).astype(np.int64)] = True
        gone = b.at[elsewhere[b.one] | (b.least[b.one] < b.ids[b.doc[b.at]])]
        edge = np.zeros(len(b.doc) + 1, np.int64)
        edge[gone] += 1
        edge[gone + window] -= 1
        covered = np.cumsum(edge)[:-1] > 0
        removed = np.bincount(b.doc[covered], minlength=len(b.ids))
        # a kept word and the byte behind it, which becomes a space
        mark = np.zeros(len(b.raw) + 1, np.int64)
        mark[b.begin[~covered]] += 1
        np.add.at(mark, b.end[~covered] + 1, -1)
        keep = np.cumsum(mark)[:-1] > 0
        text = np.where(_SPACE[b.raw], np.uint8(32), b.raw)[keep].tobytes()
        length = np.bincount(b.doc[~covered], weights=(b.end - b.begin + 1)[~covered], minlength=len(b.ids)).astype(np.int64)
        ends = np.cumsum(length)
        kept = [text[e - n : e - 1].decode() if n else "" for e, n in zip(ends.tolist(), length.tolist(), strict=True)]
        starts = np.flatnonzero(covered & ~(np.insert(covered[:-1], 0, False) & (b.doc == np.insert(b.doc[:-1], 0, -1)))) if len(covered) else np.zeros(0, np.int64)
        stops = np.flatnonzero(covered & ~(np.append(covered[1:], False) & (b.doc == np.append(b.doc[1:], -1)))) if len(covered) else starts
        first = np.cumsum(b.n_words) - b.n_words
        spans: list[list[dict]] = [[] for _ in b.ids]
        for d, s, e in zip(b.doc[starts].tolist(), (starts - first[b.doc[starts]]).tolist(), (stops - starts + 1).tolist(), strict=True):
            spans[d].append({"start": s, "length": e})
        return pa.Table.from_arrays([t.column("doc_id"), pa.array(b.n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, _RESULT.field("spans").type), pa.array(kept, pa.string())], schema=_RESULT)

    return run


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """doc_id, n_words, n_removed, spans (word number and length of what was removed), kept (the other words, by single spaces)."""
    if not 0 < prefix < window:
        raise ValueError("the prefix is shorter than the window, and not empty")
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = narrow.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # messages are as many as blocks times groups at most, so small tables get few of both
    blocks, partitions = max(2 * least, -(-total // BLOCK_BYTES)), max(least, -(-total // (8 * BLOCK_BYTES)))
    groups = max(3 * least // 2, -(-total // (6 * GROUP)))
    dealt = narrow.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "doc_id", "text").repartition(partitions, "block")
    at_home = lambda: dealt.groupBy("block")
    names = at_home().applyInArrow(_name_prefixes(window, prefix, groups), _ddl(_NAMES))
    answers = names.groupBy("to").applyInArrow(_compare_prefixes, _ddl(_NAMES))
    sent = at_home().cogroup(answers.groupBy("block")).applyInArrow(_send_suffixes(window, prefix, groups), _ddl(_SENT))
    lost = sent.groupBy("to").applyInArrow(_grow_trees, _ddl(_NAMES))
    return at_home().cogroup(lost.groupBy("block")).applyInArrow(_cut_out(window, prefix), _ddl(_RESULT))


def query(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
with d as (select row_number() over () as k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
s as (select k, doc_id, words, unnest(range(1, len(words) - 11)) as i from d where len(words) >= 13),
w as (select k, i, doc_id, array_to_string(words[i:i + 12], ' ') as win from s),
m as (select k, i, coalesce(doc_id, 9223372036854775807) > min(coalesce(doc_id, 9223372036854775807)) over (partition by win) as seen from w),
gone as (select distinct k, unnest(range(i, i + 13)) as i from m where seen),
t as (select k, unnest(range(1, len(words) + 1)) as i, unnest(words) as word from d),
r as (select t.k, count(*) filter (gone.i is not null) as n_removed, string_agg(word, ' ' order by t.i) filter (gone.i is null) as kept from t left join gone on gone.k = t.k and gone.i = t.i group by t.k)
select doc_id, len(words)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join r using (k)
"""
