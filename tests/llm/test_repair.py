"""Conversation repair against every audit, SQL, pieces of every size and odd rows."""

import hashlib
import itertools
import os
import random
import re
import zlib

import duckdb
import pytest

from ledgerline.llm import op13_repair
from ledgerline.llm.op13_repair import EMPTY, Node, Row, accepted, audit_from, edited, less

SF = "/root/testdata/sf0.001"


def every_audit(rows):
    """(cost, audit) of the best of all audits with up to two inserts in a gap."""
    best = None
    for gaps in itertools.product(range(3), repeat=len(rows) + 1):
        for edits in itertools.product("DKR", repeat=len(rows)):
            if any(r.must_go and e != "D" for r, e in zip(rows, edits, strict=True)):
                continue
            audit, slots = "I" * gaps[0], ["?"] * gaps[0]
            for r, e, g in zip(rows, edits, gaps[1:], strict=True):
                audit += e + "I" * g
                slots += ([] if e == "D" else [r.role[:1] or "!"] if e == "K" else ["?"]) + ["?"] * g
            cost = sum(2 if e in "RI" else 3 if e == "D" else 0 for e in audit) + sum(r.truncated for r, e in zip(rows, edits, strict=True) if e != "D")
            if best is not None and (cost, audit) >= best:
                continue
            if any(all(x in (y, "?") and not (x == "?" and y == "s") for x, y in zip(slots, shape, strict=False)) and len(shape) == len(slots) for shape in (("ua" * 9)[: len(slots)], "s" + ("ua" * 9)[: max(0, len(slots) - 1)]) if re.fullmatch("(s?(ua)+)?", shape)):
                best = cost, audit
    return best


def brute_conversation(rows):
    """rows after damage: (turn, role, text). The plain DP with whole strings and Python's own order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, out, counts, illegal = set(), [], [0, 0, 0], 0
    for k, (_, role, text) in enumerate(rows):
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        illegal += k > 0 and rows[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        out.append((role, text, fault in (0, 1), fault == 2))
    best = {"": (0, "", ())}

    def offer(to, key, value):
        if key not in to or value[:2] < to[key][:2]:
            to[key] = value

    def closed(b):
        b = dict(b)
        for _ in range(2):
            for key, (c, a, o) in list(b.items()):
                nxt = "a" if key == "u" else "u"
                offer(b, nxt, (c + 2, a + "I", (*o, ({"u": "user", "a": "assistant"}[nxt], ""))))
        return b

    for role, text, go, cut in out:
        after = {}
        for key, (c, a, o) in closed(best).items():
            offer(after, key, (c + 3, a + "D", o))
            if not go:
                nxt, ini = "a" if key == "u" else "u", role[:1]
                if ini == nxt or (ini == "s" and key == ""):
                    offer(after, ini, (c + cut, a + "K", (*o, (role, text))))
                offer(after, nxt, (c + 2 + cut, a + "R", (*o, ({"u": "user", "a": "assistant"}[nxt], text))))
        best = after
    cost, audit, left = min((v for k, v in closed(best).items() if k in ("", "a")), key=lambda v: v[:2])
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())


def brute(table):
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: brute_conversation(r) for c, r in convs.items()}


def got(df):
    return {r[0]: tuple(r)[1:] for r in op13_repair.query(df).collect()}


def test_best_of_all_audits():
    rng = random.Random(13)
    for _ in range(120):
        rows = [Row(rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]), "x", rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(5))]
        cost, node = accepted(audit_from(EMPTY, rows))
        assert (cost, node.audit()) == every_audit(rows)
        state, left = edited(EMPTY, node.audit(), rows)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in left))


def test_order_of_audits_is_that_of_strings(monkeypatch):
    rng = random.Random(1)
    for hashes in (False, True):
        if hashes:  # hashes that all collide decide nothing
            monkeypatch.setattr(op13_repair, "_MASK", 0)
        made = {"": Node()}
        for _ in range(300):
            s = rng.choice(list(made))
            made.setdefault(s + (e := rng.choice("DIKR")), Node(made[s], e))
        for a, b in itertools.islice(itertools.product(made, made), 0, 20000):
            assert less(made[a], made[b]) == (a < b), (a, b)
        assert all(n.audit() == s for s, n in made.items())


def test_query_against_brute_force_and_sql(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = got(df)
    assert rows == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{os.path.join(SF, 'conversations.parquet')}'")
    assert {r[0]: r[1:] for r in db.execute(op13_repair.SQL).fetchall()} == rows


ODD = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, None, "system", "Be."), (1, None, None, None), (1, 7, "", "No role."), (1, 9, "tool", "x" * 200_000), (None, None, "user", "q?"), (None, 3, "assistant", "a"), (2, 5, None, ""), (3, 1, "assistant", "é. ")]


@pytest.mark.parametrize("piece", [1024, 3, 1])
def test_pieces_of_every_size(spark, monkeypatch, piece):
    """Conversations of many pieces in many partitions give the same as whole ones; one has two thirds of all rows."""
    rng = random.Random(piece)
    table = [(0 if rng.random() < 0.6 else rng.randrange(1, 9), rng.randrange(40), rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "B", "", f"{rng.random()}.", f"{rng.random()}"])) for _ in range(300)]
    monkeypatch.setattr(op13_repair, "PIECE_ROWS", piece)
    df = spark.createDataFrame(table + ODD, "conv_id long, turn long, role string, text string")
    assert got(df) == brute(table + ODD)


def test_odd_tables(spark):
    df = spark.createDataFrame([(*r, 1, "c") for r in ODD], "conv_id long, turn long, role string, text string, n int, said string")
    assert got(df) == brute(ODD) and op13_repair.query(df.limit(0)).count() == 0
    dropped = [(c, t) for c in range(100) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:1]
    one = spark.createDataFrame([(c, t, "user", "x.") for c, t in dropped], "conv_id long, turn long, role string, text string")
    assert got(one) == {dropped[0][0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
