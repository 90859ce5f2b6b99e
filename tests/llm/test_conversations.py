"""Conversation repair against a plain search over all edits, whole and cut into pieces."""
import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from horosphere.llm import conversation_repair as C

ROLES = {"s": "system", "u": "user", "a": "assistant", "?": "tool"}


def best(rows):
    """(cost, audit) by trying every edit at every row."""
    @functools.lru_cache(None)
    def go(i, state, inserts):
        ways = []
        if i == len(rows):
            if state in (C.EMPTY, C.ASSISTANT):
                ways.append((0, ""))
        else:
            role, gone, cut = rows[i]
            c, t = go(i + 1, state, 0)
            ways.append((c + 3, "D" + t))
            if not gone:
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], state))
                if to:
                    c, t = go(i + 1, to, 0)
                    ways.append((c + cut, "K" + t))
                c, t = go(i + 1, 3 if state == 2 else 2, 0)
                ways.append((c + 2 + cut, "R" + t))
        if inserts < 4:
            c, t = go(i, 3 if state == 2 else 2, inserts + 1)
            ways.append((c + 2, "I" + t))
        return min(ways, default=(10**9, ""))
    return go(0, C.EMPTY, 0)


def replay(rows, audit):
    out, state, at = [], C.EMPTY, 0
    for op in audit:
        role, text = rows[at] if op != "I" else ("", "")
        at += op != "I"
        if op == "D":
            continue
        to = C.SYSTEM if op == "K" and role[:1] == "s" else 3 if state == 2 else 2
        out.append((role if op == "K" else C.ROLE[to], text))
        state = to
    return out


def random_rows(rnd, n, roles="suua?a", faults="----bdt"):
    return [(i, ROLES[rnd.choice(roles)], f"t{i}", rnd.choice(faults)) for i in range(n)]


@pytest.mark.parametrize("roles,faults", [("suua?a", "----bdt"), ("ua", "-t"), ("aau", "-"), ("s", "-t"), ("?", "-b")])
def test_least_edits(roles, faults):
    rnd = random.Random(roles + faults)
    for _ in range(400):
        rows = random_rows(rnd, rnd.randint(0, 13), roles, faults)
        cost, audit = best([(r[1], r[3] in "bd", int(r[3] == "t")) for r in rows])
        s = C.summary(rows, range(1))
        assert s["cost"][s["exit"]] + C.CLOSE[s["exit"]][0] == cost
        got, out = C.repaired(rows, C.EMPTY, s["exit"], True)
        assert got == audit
        assert out == replay([(r[1], r[2]) for r in rows], audit)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))


def test_pieces_join_in_any_grouping():
    rnd = random.Random(8)
    for _ in range(500):
        rows = random_rows(rnd, rnd.randint(0, 16))
        cuts = [0, *sorted(rnd.choices(range(len(rows) + 1), k=3)), len(rows)]
        parts = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
        whole, sums = C.summary(rows, range(1)), [C.summary(p, range(4)) for p in parts]
        k = rnd.randint(1, 3)
        both = [C.joined(sums[:k]), C.joined(sums[k:])]
        top = C.joined(both)
        if rows:
            assert all(top[f] == whole[f] for f in whole if f not in ("cost", "way"))
        (a, b), (_, c) = C.between(both, C.EMPTY, top["exit"])
        states = C.between(sums[:k], a, b) + C.between(sums[k:], b, c)
        found = [C.repaired(p, x, y, i == 3) for i, (p, (x, y)) in enumerate(zip(parts, states))]
        audit, out = C.repaired(rows, C.EMPTY, whole["exit"], True)
        assert "".join(f[0] for f in found) == audit
        assert [r for f in found for r in f[1]] == out


def test_settled_edits_leave_memory():
    """Turns in order leave a short tail only, however long the conversation is; ties keep whole texts."""
    w, longest = C.Survivors(C.EMPTY), 0
    rnd = random.Random(1)
    for i in range(5000):
        w.step("ua"[i % 2] if rnd.random() < 0.9 else "?", False, rnd.random() < 0.2)
        longest = max(longest, max(len(w.unresolved(n)) for n in w.leaf if n))
    assert longest < 60
    w, emitted = C.Survivors(C.USER), []
    for _ in range(300):
        emitted += w.step("u", False, False)
    rows = [(i, "user", "x", "-") for i in range(300)]
    assert "".join(emitted) + "".join(w.finish(w.order()[0])) != ""
    cost, audit = best([(r[1], False, 0) for r in rows[:40]])
    s = C.summary(rows[:40], range(1))
    assert C.repaired(rows[:40], C.EMPTY, s["exit"], True)[0] == audit


def expected(rows):
    """The contract, conversation by conversation."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = convs[conv]
        one = lambda v: " " if v is None else str(v)
        h = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        kept += [(turn, role, text)] * (1 + (h == 3))
    out = []
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in kept:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not solid else "d" if (role, text) in seen else "-" if solid[-1] in ".!?" else "t")
            seen.add((role, text))
        turns = [t for t, *_ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit = best([(r[1], f in "bd", int(f == "t")) for r, f in zip(kept, faults)])
        text = "\n".join(f"{r}:{t}" for r, t in replay([r[1:] for r in kept], audit))
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), bad, cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                       T.StructField("cost", T.StringType()), T.StructField("items", T.StringType()),
                       T.StructField("a.b", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def odd_rows():
    rnd = random.Random(12)
    texts = ["Yes.", "No", "", " \t\n", None, "What? ", " ", "End!\n", "é", "x" * 70_000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    return [(rnd.choice([None, 1, 2, 3, 2**60, -4]), rnd.choice([None, 0, 1, 2, 3, 4, 9, 2**55]),
             rnd.choice(roles), rnd.choice(texts)) for _ in range(150)] + [(7, 1, "user", "A.")] * 20


def test_odd_rows(spark):
    rows = odd_rows()
    got = C.repair_digests(frame(spark, rows).repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
    assert C.repair_digests(frame(spark, [])).count() == 0


def test_a_conversation_larger_than_pieces(spark, monkeypatch):
    """One conversation holds most rows, over many partitions and pieces; equal rows, too."""
    monkeypatch.setattr(C, "PIECE_ROWS", 7)
    monkeypatch.setattr(C, "FAN_BITS", 1)
    rnd = random.Random(4)
    rows = [(5, t, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["Hi.", "So", "", f"t{t}.", f"t{t}"]))
            for t in range(300)] + [(5, 3, "user", "Same.")] * 60 + [(i, t, "user", f"{t}.") for i in (1, 9) for t in range(3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = C.repair_digests(frame(spark, rows).repartition(3))
        assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
        told = C.repaired_messages(C.damaged(frame(spark, rows))).orderBy("conv_id", "place").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    lines = "\n".join(f"{r.role}:{r.text}" for r in told if r.conv_id == 5)
    assert hashlib.sha256(lines.encode()).hexdigest() == next(r for r in expected(rows) if r[0] == 5)[-1]
