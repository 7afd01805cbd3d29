"""Conversation structure repair: the cheapest edits that make a conversation well formed, as a persistent audit DP.

A well-formed conversation is empty, or has roles s?(ua)+ by their initials. Edits: K keeps a row (0), R gives it the role
user or assistant (2), D deletes it (3; blank rows and duplicates must go), I inserts an empty row of user or assistant
anywhere (2); a truncated row that stays costs 1 more. Of the cheapest audits the ASCII-least is taken.

The DP has four states: nothing yet, after s, after u, after a. The best audit of a state is a linked node (parent, edit),
so states share their prefixes; a node has ancestors at powers of two and a rolling hash of the audit up to it. Audits of
equal cost are compared at the end of their longest common prefix, which is searched by the hashes; a prefix that hashes call
equal is walked back to the shared node, so a collision can't decide. (Two cheapest audits of the same rows and state
are never prefixes of each other, as the longer would cost more; so the best audit of each state is enough.)

Partitions: identical rows are counted first, so that a row with any number of copies is one row with a count. Rows are dealt out by
ranges of (conversation, turn, role, beginning of the text), so a conversation of any size lies in consecutive partitions, in
order, and no task gets more of it than its range. A task reads its rows as a stream. A conversation that lies inside is
repaired there; one that touches an end of the partition or has more than PIECE_ROWS rows becomes pieces, each with the best
audit from every state to every state. Pieces are put together in order, and their rows are edited when the audit is known.

Defined cases: null roles and texts, and nulls in the damage's key, are one space, so a null text is blank; rows without a conversation form
one; null turns come first; rows of equal turn are ordered by role and text; an empty role has no initial and can't be kept;
repeated rows are duplicates; very long texts are taken whole; an empty table gives an empty result; further columns
take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_sql, slices, written

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"s": "system", "u": "user", "a": "assistant"}
EMPTY, S, U, A = range(4)
#: (role initial, state before) -> state after
STEP = {("s", EMPTY): S, ("u", EMPTY): U, ("u", S): U, ("u", A): U, ("a", U): A}

#: A piece has at most so many rows, or one row with a text beyond so many characters.
PIECE_ROWS, PIECE_CHARS = 1024, 4_000_000

_MASK, _BASE = (1 << 61) - 1, 1_000_003


class Node:
    """An audit: its last edit and the audit before it; up[k] is the audit 2^k edits shorter."""

    __slots__ = ("depth", "edit", "hash", "up")

    def __init__(self, before: Node | None = None, edit: str = "") -> None:
        self.edit = edit
        if before is None:
            self.depth, self.hash, self.up = 0, 0, ()
            return
        self.depth, self.hash = before.depth + 1, (before.hash * _BASE + ord(edit)) & _MASK
        up, k = [before], 0
        while k < len(up[k].up):
            up.append(up[k].up[k])
            k += 1
        self.up = tuple(up)

    def at(self, depth: int) -> Node:
        node, k = self, 0
        climb = self.depth - depth
        while climb:
            if climb & 1:
                node = node.up[k]
            climb >>= 1
            k += 1
        return node

    def audit(self) -> str:
        edits, node = [], self
        while node.depth:
            edits.append(node.edit)
            node = node.up[0]
        return "".join(reversed(edits))


def same(x: Node, y: Node) -> bool:
    """Whether two audits of equal length and hash are equal, edit by edit back to the node that they share."""
    while x is not y:
        if x.edit != y.edit:
            return False
        x, y = x.up[0], y.up[0]
    return True


def less(x: Node, y: Node) -> bool:
    """ASCII order of two audits, by the edits after their longest common prefix."""
    depth = min(x.depth, y.depth)
    a, b = x.at(depth), y.at(depth)
    if a.hash == b.hash:
        return x.depth < y.depth if same(a, b) else x.audit() < y.audit()
    for k in range(len(a.up) - 1, -1, -1):
        if k < len(a.up) and a.up[k].hash != b.up[k].hash:
            a, b = a.up[k], b.up[k]
    if not same(a.up[0], b.up[0]):  # a collision of hashes hid an earlier difference
        return x.audit() < y.audit()
    return a.edit < b.edit


Best = dict[int, tuple[int, Node]]


def _offer(best: Best, state: int, cost: int, before: Node, edit: str) -> None:
    old = best.get(state)
    if old is None or cost < old[0]:
        best[state] = cost, Node(before, edit)
    elif cost == old[0] and less(node := Node(before, edit), old[1]):
        best[state] = cost, node


def inserted(best: Best) -> Best:
    """The states that inserts reach, before a row or at the end; more than two in a row only come back to a state."""
    best = dict(best)
    for state, (cost, node) in [(k, v) for k, v in best.items() if k != U]:
        _offer(best, U, cost + INSERT, node, "I")
    if U in best:
        _offer(best, A, best[U][0] + INSERT, best[U][1], "I")
    return best


def row_step(best: Best, initial: str, must_go: bool, truncated: bool) -> Best:
    after: Best = {}
    more = TRUNCATED if truncated else 0
    for state, (cost, node) in inserted(best).items():
        _offer(after, state, cost + DELETE, node, "D")
        if not must_go:
            if (initial, state) in STEP:
                _offer(after, STEP[initial, state], cost + KEEP + more, node, "K")
            _offer(after, A if state == U else U, cost + REROLE + more, node, "R")
    return after


def audit_from(start: int, rows: Iterable[Row]) -> Best:
    best: Best = {start: (0, Node())}
    for r in rows:
        best = row_step(best, r.role[:1], r.must_go, r.truncated)
    return best


def accepted(best: Best) -> tuple[int, Node]:
    """The best of the states in which a conversation may end."""
    ends = [v for k, v in inserted(best).items() if k in (EMPTY, A)]
    first = ends[0]
    for x in ends[1:]:
        if x[0] < first[0] or x[0] == first[0] and less(x[1], first[1]):
            first = x
    return first


def edited(state: int, audit: str, rows: Iterable[Row]) -> tuple[int, list[tuple[str, str]]]:
    """The state after the edits, and the rows that they leave."""
    out, it = [], iter(rows)
    for edit in audit:
        row = None if edit == "I" else next(it)
        if edit == "D":
            continue
        initial = row.role[:1] if edit == "K" else "a" if state == U else "u"
        out.append((row.role if edit == "K" else ROLES[initial], row.text if row else ""))
        state = STEP[initial, state]
    return state, out


@dataclass(frozen=True)
class Row:
    role: str
    text: str
    must_go: bool
    truncated: bool


@dataclass
class Piece:
    """Consecutive rows of one conversation, with what can be added up."""

    conv: int | None
    rows: list[Row] = field(default_factory=list)
    chars: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None  # initials of the outer rows; None: no rows
    last: str | None = None
    low: int | None = None  # turns
    high: int | None = None
    turns: int = 0

    def add(self, turn: int | None, role: str, text: str, duplicate: bool, n: int) -> None:
        """n rows alike, of which the first may be the original."""
        bare = text.strip(SPACES)
        blank, cut = not bare, bool(bare) and bare[-1] not in ".!?"
        self.blank += n * blank
        self.duplicate += 0 if blank else n if duplicate else n - 1
        self.truncated += cut and not duplicate
        self.illegal += (self.last is not None and self.last + role[:1] not in ("su", "ua", "au")) + n - 1
        self.last = role[:1]
        self.first = self.last if self.first is None else self.first
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        original = Row(role, text, blank or duplicate, cut)
        self.rows += [original, *[Row(role, "", True, False)] * (n - 1)]
        self.chars += len(text)


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_ROWS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("must_go", pa.bool_()), ("truncated", pa.bool_())]))
_PIECES = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("whole", pa.bool_()), *((c, pa.int64()) for c in _COUNTS),
    ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
    ("ways", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))), ("rows", _ROWS),
])
_PIECES_DDL = (
    "conv_id long, part int, seq long, whole boolean, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, cost long, audit string, "
    "ways array<struct<start: int, end: int, cost: long, audit: string>>, rows array<struct<role: string, text: string, must_go: boolean, truncated: boolean>>"
)


def _told(p: Piece, part: int, seq: int, whole: bool, starts: Iterable[int]) -> dict:
    told = {c: getattr(p, c) for c in (*_COUNTS, "first", "last", "low", "high", "turns")} | {"conv_id": p.conv, "part": part, "seq": seq, "whole": whole}
    if whole:
        cost, node = accepted(audit_from(EMPTY, p.rows))
        audit = node.audit()
        _, left = edited(EMPTY, audit, p.rows)
        return told | {"cost": cost, "audit": audit, "ways": None, "rows": [{"role": r, "text": t, "must_go": False, "truncated": False} for r, t in left]}
    ways = [{"start": s, "end": e, "cost": c, "audit": node.audit()} for s in starts for e, (c, node) in audit_from(s, p.rows).items()]
    return told | {"cost": None, "audit": None, "ways": ways, "rows": [vars(r) for r in p.rows]}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq, piece, out, size = TaskContext.get().partitionId(), 0, None, [], 0
    inner = False  # the conversation began in this partition, and all its rows so far are in the piece

    def close(whole: bool) -> None:
        nonlocal seq, size
        out.append(_told(piece, part, seq, whole, (EMPTY,) if inner else range(4)))
        seq += 1
        size += piece.chars

    for b in slices(batches):
        for conv, turn, role, text, n, duplicate in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if piece is None:
                piece = Piece(conv)
            elif conv != piece.conv:
                close(inner)
                piece, inner = Piece(conv), True
            while n:  # none of a dropped row; its conversation is there all the same
                if len(piece.rows) >= PIECE_ROWS or piece.chars >= PIECE_CHARS:
                    close(False)
                    piece, inner = Piece(conv), False
                k = min(n, PIECE_ROWS - len(piece.rows))
                piece.add(turn, role, text, duplicate, k)
                n, duplicate = n - k, True
        if len(out) >= 1000 or size >= PIECE_CHARS:
            yield pa.RecordBatch.from_pylist(out, _PIECES)
            out, size = [], 0
    if piece is not None:
        close(False)
    if out:
        yield pa.RecordBatch.from_pylist(out, _PIECES)


def pieces(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text, n (copies; 0 for a row that is only named). Conversations that are whole have their audit and the rows
    that it leaves; pieces of the others have the best audit from each state to each, and their rows."""
    one = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    # the first turn with a role and text; counted from least to most, as a null turn comes before all
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    said = F.sha2(F.concat(F.base64(F.col("role").cast("binary")), F.lit(":"), F.col("text")).cast("binary"), 256)
    keyed = written(one.withColumn("said", said))
    first = keyed.filter("n > 0").groupBy("conv_id", "said").agg(F.min(turn).alias("earliest")).withColumnRenamed("conv_id", "c").withColumnRenamed("said", "s")
    joined = keyed.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    flagged = joined.select("conv_id", "turn", "role", "text", "n", F.coalesce(turn > F.col("earliest"), F.lit(False)).alias("duplicate"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]
    dealt = flagged.repartitionByRange(*order, F.substring("text", 1, 64).asc()).sortWithinPartitions(*order, F.col("text").asc())
    return dealt.mapInArrow(_pieces, _PIECES_DDL)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of conversations, each conversation's in order -> one row a conversation (part null), one row a piece with its edits."""
    kinds = pa.schema([f for f in _PIECES if f.name not in ("whole", "first", "last", "low", "high", "turns", "ways", "rows")] + [pa.field("gaps", pa.int64()), pa.field("state", pa.int32())])
    conv, began, out = None, False, []

    def finish() -> None:
        # the ends that are accepted, each with the inserts that lead there
        ends = []
        for state, (cost, chain) in best.items():
            done = accepted({state: (0, Node())})
            ends.append((cost + done[0], chain, done[1].audit()))
        cost, chain, more = min(ends, key=lambda e: e[0])
        for c, other, m in ends:
            if c == cost and (other is not chain) and _spelled(other, m) < _spelled(chain, more):
                chain, more = other, m
        steps, node = [], chain
        while node is not None:
            steps.append((node[1], node[2], node[3]))
            node = node[0]
        steps.reverse()
        out.append({"conv_id": conv, "part": None, "seq": None, **sums, "gaps": high - low + 1 - turns if turns else 0, "cost": cost, "audit": "".join(s[0] for s in steps) + more, "state": None})
        for k, (edits, start, at) in enumerate(steps):
            out.append({"conv_id": conv, "part": at[0], "seq": at[1], **dict.fromkeys(_COUNTS), "gaps": None, "cost": None, "audit": edits + more * (k == len(steps) - 1), "state": start})

    for b in slices(batches):
        for p in b.to_pylist():
            if not began or p["conv_id"] != conv:
                if began:
                    finish()
                conv, began = p["conv_id"], True
                best, sums = {EMPTY: (0, None)}, dict.fromkeys(_COUNTS, 0)
                last, low, high, turns = None, None, None, 0
            for c in _COUNTS:
                sums[c] += p[c]
            if p["first"] is not None:
                sums["illegal"] += last is not None and last + p["first"] not in ("su", "ua", "au")
                last = p["last"]
            if p["turns"]:
                turns += p["turns"] - (p["low"] == high)
                low, high = p["low"] if low is None else low, p["high"]
            after: dict[int, tuple[int, tuple | None]] = {}
            for w in p["ways"]:
                if w["start"] in best:
                    cost, chain = best[w["start"]]
                    cost, node = cost + w["cost"], (chain, w["audit"], w["start"], (p["part"], p["seq"]))
                    old = after.get(w["end"])
                    if old is None or cost < old[0] or cost == old[0] and _before(node, old[1]):
                        after[w["end"]] = cost, node
            best = after
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, kinds)
            out.clear()
    if began:
        finish()
    if out:
        yield pa.RecordBatch.from_pylist(out, kinds)


def _tails(x: tuple | None, y: tuple | None) -> tuple[str, str]:
    """What two chains of as many pieces say after the piece up to which they are the same."""
    a, b = [], []
    while x is not y:
        a.append(x[1])
        b.append(y[1])
        x, y = x[0], y[0]
    return "".join(reversed(a)), "".join(reversed(b))


def _before(x: tuple, y: tuple) -> bool:
    a, b = _tails(x, y)
    return a < b


def _spelled(chain: tuple | None, more: str) -> str:
    parts = [more]
    while chain is not None:
        parts.append(chain[1])
        chain = chain[0]
    return "".join(reversed(parts))


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their edits and the state before them -> the rows that the edits leave."""
    kinds = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("messages", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
    for b in slices(batches):
        out = []
        for p in b.to_pylist():
            _, left = edited(p["state"], p["audit"], [Row(**r) for r in p["rows"]])
            out.append({"conv_id": p["conv_id"], "part": p["part"], "seq": p["seq"], "messages": [{"role": r, "text": t} for r, t in left]})
        yield pa.RecordBatch.from_pylist(out, kinds)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, lines or null), each conversation's in order -> conv_id and the digest of its lines; one line is held at a time."""
    kinds = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    conv, sha, empty, out = None, None, True, []
    for b in slices(batches):
        for key, lines in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if sha is None or key != conv:
                if sha is not None:
                    out.append({"conv_id": conv, "repaired_sha256": sha.hexdigest()})
                conv, sha, empty = key, hashlib.sha256(), True
            if lines is not None:
                sha.update(lines.encode() if empty else b"\n" + lines.encode())
                empty = False
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, kinds)
            out = []
    if sha is not None:
        out.append({"conv_id": conv, "repaired_sha256": sha.hexdigest()})
    yield pa.RecordBatch.from_pylist(out, kinds)


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: conv_id long, turn long, role, text, n. Two tables: one row a conversation (counts of faults, gaps, cost, audit); and
    conv_id, part, seq, messages: the repaired rows, in order of part and seq."""
    made = written(pieces(rows))
    whole, parted = made.filter("whole"), made.filter("not whole")
    order = ["conv_id", "part", "seq"]
    streamed = parted.drop("rows").repartition("conv_id").sortWithinPartitions(*order)
    wanted = [f.name for f in _PIECES if f.name not in ("whole", "first", "last", "low", "high", "turns", "ways", "rows")]
    ddl = {f.name: f.dataType.simpleString() for f in made.schema}
    joined = written(streamed.mapInArrow(_joined, ", ".join(f"`{c}` {ddl[c]}" for c in wanted) + ", gaps long, state int"))
    facts = ["conv_id", "gaps", *_COUNTS, "cost", "audit"]
    gaps = F.when(F.col("turns") > 0, F.col("high") - F.col("low") + 1 - F.col("turns")).otherwise(0)
    audits = whole.withColumn("gaps", gaps).select(*facts).union(joined.filter("part is null").select(*facts))
    edits = joined.filter("part is not null").select("part", "seq", "audit", "state")
    mended = parted.select("conv_id", "part", "seq", "rows").join(edits, ["part", "seq"]).select("conv_id", "part", "seq", "audit", "state", "rows")
    messages = mended.mapInArrow(_mended, "conv_id long, part int, seq long, messages array<struct<role: string, text: string>>")
    return audits, whole.select("conv_id", "part", "seq", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("messages")).union(messages)


def damaged(rows: DataFrame) -> DataFrame:
    """The damage that the query plants, by the checksum of conversation and turn; n is 0 for dropped rows and 2 for repeated ones."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"))
    kind: Column = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.withColumn("kind", kind).select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("n"))


def query(rows: DataFrame) -> DataFrame:
    audits, messages = repaired(damaged(rows))
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    ordered = messages.select("conv_id", "part", "seq", F.when(F.size("messages") > 0, F.array_join(lines, "\n")).alias("lines")).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    digests = ordered.select("conv_id", "lines").mapInArrow(_digests, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "c")
    return audits.join(digests, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "gaps", *_COUNTS, "cost", "audit", "repaired_sha256")


SQL = r"""
with recursive c as (select conv_id, coalesce(cast(conv_id as varchar), ' ') as k, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                  CRC % 20 as kind from conversations),
d as (select k, turn, case when kind = 4 then 'user' else role end as role,
             case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when kind = 3 then 2 else 1 end)) as copy
      from c where kind <> 0),
o as (select *, row_number() over (partition by k order by turn nulls first, role, text) as i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as ends from d),
f as (select *, ends = '' as blank, ends not in ('', '.', '!', '?') as cut, row_number() over (partition by k, role, text order by i) > 1 as again,
             lag(role[1]) over (partition by k order by i) || role[1] not in ('su', 'ua', 'au') as jump from o),
counts as (select k, case when max(turn) is null then 0 else max(turn) - min(turn) + 1 - count(distinct turn) end as gaps, count_if(blank) as blank,
                  count_if(again and not blank) as duplicate, count_if(cut and not again) as truncated, count_if(jump) as illegal, count(*) as n from f group by k),
-- states: 0 nothing, 1 after s, 2 after u, 3 after a
ins(s0, s1, edits, cost, lines) as (values (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''), (0, 2, 'I', 2, chr(10) || 'user:'), (1, 2, 'I', 2, chr(10) || 'user:'),
    (3, 2, 'I', 2, chr(10) || 'user:'), (2, 3, 'I', 2, chr(10) || 'assistant:'), (0, 3, 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:')),
op(initial, s1, s2, edit, cost, role) as (values ('s', 0, 1, 'K', 0, null), ('u', 0, 2, 'K', 0, null), ('u', 1, 2, 'K', 0, null), ('u', 3, 2, 'K', 0, null), ('a', 2, 3, 'K', 0, null), (null, 0, 2, 'R', 2, 'user'),
    (null, 1, 2, 'R', 2, 'user'), (null, 3, 2, 'R', 2, 'user'), (null, 2, 3, 'R', 2, 'assistant'), (null, 0, 0, 'D', 3, ''), (null, 1, 1, 'D', 3, ''), (null, 2, 2, 'D', 3, ''), (null, 3, 3, 'D', 3, '')),
r as (
    select k, 0::bigint as i, 0 as state, {'cost': 0, 'audit': '', 'lines': ''} as best from counts
    union all
    select r.k, r.i + 1, op.s2, min({'cost': r.best.cost + ins.cost + op.cost + case when op.edit <> 'D' and f.cut then 1 else 0 end, 'audit': r.best.audit || ins.edits || op.edit,
                                     'lines': r.best.lines || ins.lines || case when op.edit = 'D' then '' else chr(10) || coalesce(op.role, f.role) || ':' || f.text end})
    from r join f on f.k = r.k and f.i = r.i + 1 join ins on ins.s0 = r.state join op on op.s1 = ins.s1 and (op.initial is null or op.initial = f.role[1])
    where op.edit = 'D' or not (f.blank or f.again) group by r.k, r.i, op.s2),
e as (select r.k, min({'cost': r.best.cost + ins.cost, 'audit': r.best.audit || ins.edits, 'lines': r.best.lines || ins.lines}) as best
      from r join counts on counts.k = r.k and counts.n = r.i join ins on ins.s0 = r.state where ins.s1 in (0, 3) group by r.k)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
       coalesce(illegal, 0)::bigint as illegal, coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit, sha256(coalesce(best.lines[2:], '')) as repaired_sha256
from (select distinct conv_id, k from c) left join counts using (k) left join e using (k)
""".replace("CRC", crc32_sql("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')"))
