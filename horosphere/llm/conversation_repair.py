"""Repairing the role structure of conversations by a survivor-coalescence Viterbi search.

A conversation is well formed if its roles read ``(s?(ua)+)?``: nothing, or an
optional system message and then user and assistant in turn. The cheapest edits
(keep, rerole, delete, insert) are found state by state; every state keeps its
best way so far as a leaf of a tree of backpointers with reference counts.
Where two ways into a state cost the same, their whole unresolved parts are
compared. Ways that can no longer win are cut off, nodes without leaves are
freed, and once all leaves share an ancestor the edits up to it are emitted, so memory
holds the unresolved part only.

Conversations may be as large as the table. Rows are range-partitioned in
conversation order, and a conversation that does not lie within one partition and one
piece is cut into pieces of bounded size. A piece is searched from every
state it may begin in, which gives the cost and the order of the best ways
between states; these combine in any grouping, so pieces are joined in levels
of bounded fan-in, the states at all cuts follow from the top down, and
each piece then emits its own edits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horosphere.llm.tables import kept

#: States: nothing yet, system, user, assistant said last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Prices of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FAR = 1 << 60
#: Rows and characters of a piece at most (one row at least); summaries joined at a time.
PIECE_ROWS, PIECE_CHARS = 1024, 1 << 16
FAN_BITS = 8

_SOLID = re.compile(r"[^\x20\x09-\x0D]")
_LAST_SOLID = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")
#: Where a user or assistant message leads to, and the only one that may follow.
_NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: What any continuation costs more from the first state than from the second, at most.
_BEHIND = [[0, 0, 2, 0], [4, 0, 2, 4], [5, 2, 0, 2], [3, 0, 2, 0]]


def _moves() -> dict[tuple[str, bool], list[list[tuple[int, int, str]]]]:
    """(target, cost, edits) from every state for a row that must go, or has the initial s, u, a or another.
    Inserts stand before the row they make room for: later they cost the same and read greater."""
    out = {}
    for initial in ("s", "u", "a", "?"):
        per_state = []
        for state in range(4):
            best: dict[tuple[int, str], tuple[int, str]] = {}
            at, cost, text = state, 0, ""
            for _ in range(3):
                ways = [(_NEXT[at], cost + REROLE, text + "R")]
                if initial == "s" and at == EMPTY:
                    ways.append((SYSTEM, cost, text + "K"))
                if {"u": USER, "a": ASSISTANT}.get(initial) == _NEXT[at]:
                    ways.append((_NEXT[at], cost, text + "K"))
                for to, c, t in ways:
                    best[to] = min(best.get(to, (FAR, "")), (c, t))
                at, cost, text = _NEXT[at], cost + INSERT, text + "I"
            per_state.append([(to, c, t) for to, (c, t) in best.items()])
        out[initial] = per_state
    return out


_MOVES = _moves()


class Node:
    """A step of a way: the edits of one row, the step before, and how many leaves or steps rest on it."""

    __slots__ = ("parent", "edits", "refs")

    def __init__(self, parent, edits: str):
        self.parent, self.edits, self.refs = parent, edits, 0
        if parent is not None:
            parent.refs += 1


class Survivors:
    """The best way into each state, from one state on; ``step`` takes a row and returns the edits of rows
    that are settled by it, one string for each."""

    def __init__(self, state: int):
        self.root = Node(None, "")
        self.root.refs = 1
        self.leaf: list[Node | None] = [None] * 4
        self.cost = [FAR] * 4
        self.leaf[state], self.cost[state] = self.root, 0

    def unresolved(self, node: Node) -> list[str]:
        parts = []
        while node is not self.root:
            parts.append(node.edits)
            node = node.parent
        return parts[::-1]

    def _before(self, a: tuple[Node, str], b: tuple[Node, str]) -> bool:
        """Whether way ``a`` reads less than ``b``: whole unresolved texts, both end in a row's edit."""
        if a[0] is b[0]:
            return a[1] < b[1]
        x, y = a[0], b[0]                        # as many rows each: meet at the last common step
        tail_x, tail_y = [a[1]], [b[1]]
        while x is not y:
            tail_x.append(x.edits)
            tail_y.append(y.edits)
            x, y = x.parent, y.parent
        return "".join(reversed(tail_x)) < "".join(reversed(tail_y))

    def step(self, initial: str, must_go: bool, truncated: bool) -> list[str]:
        cost, leaf = [FAR] * 4, [None] * 4
        moves = _MOVES[initial]
        for state in range(4):
            if self.cost[state] == FAR:
                continue
            ways = [(state, DELETE, "D")]
            if not must_go:
                ways += [(to, c + TRUNCATED * truncated, t) for to, c, t in moves[state]]
            for to, c, edits in ways:
                c += self.cost[state]
                way = (self.leaf[state], edits)
                if c < cost[to] or c == cost[to] and self._before(way, leaf[to]):
                    cost[to], leaf[to] = c, way
        for t in range(4):                       # a way that another is sure to beat
            if any(cost[s] + _BEHIND[s][t] < cost[t] for s in range(4)):
                cost[t], leaf[t] = FAR, None
        low = min(cost)
        old, self.leaf = self.leaf, [Node(*way) if way else None for way in leaf]
        self.cost = cost
        for node in self.leaf:
            if node is not None:
                node.refs += 1
        for node in old:                         # leaves that none has followed are freed, up to a fork
            if node is not None:
                node.refs -= 1
                while node.refs == 0 and node.parent is not None:
                    node = node.parent
                    node.refs -= 1
        assert low < FAR
        return self._settled()

    def _settled(self) -> list[str]:
        """Edits up to the ancestor that all leaves share; it becomes the root."""
        alive = [n for n in self.leaf if n is not None]
        if len(alive) > 1 and self.root.refs > 1:
            return []
        top = alive[0]
        if len(alive) > 1:
            chain = []
            while top is not self.root:
                chain.append(top)
                top = top.parent
            for node in reversed(chain):         # down from the root while nothing forks off
                if self.leaf.count(node) or node.refs > 1:
                    top = node
                    break
        out = self.unresolved(top)
        top.parent, top.edits, self.root = None, "", top
        return out

    def order(self) -> list[int]:
        """The states in the order of their ways' texts (those without a way last)."""
        texts = {s: "".join(self.unresolved(n)) for s, n in enumerate(self.leaf) if n is not None}
        return sorted(range(4), key=lambda s: (s not in texts, texts.get(s, ""), s))

    def finish(self, state: int) -> list[str]:
        """The remaining rows' edits of the way into ``state``."""
        return self.unresolved(self.leaf[state])


#: What ends a conversation from each state: cost and edits.
CLOSE = {EMPTY: (0, ""), SYSTEM: (4, "II"), USER: (2, "I"), ASSISTANT: (0, "")}


def exit_state(cost: list[int], order: list[int]) -> int:
    """The state from which closing is cheapest; of equal ones the way that reads least."""
    return min(range(4), key=lambda s: (cost[s] + CLOSE[s][0], order.index(s)))


# --- a row's faults and a piece's summary ---------------------------------------------------------------------

def fault(text: str, seen: bool) -> str:
    """b(lank), d(uplicate), t(runcated) or '-'."""
    last = _LAST_SOLID.search(text)
    if last is None:
        return "b"
    return "d" if seen else "-" if last.group(1) in ".!?" else "t"


def _initial(role: str) -> str:
    return role[0] if role[:1] in ("s", "u", "a") else "?"


def _illegal(a: str, b: str) -> bool:
    return a[:1] + b[:1] not in ("su", "ua", "au")


def summary(rows: list[tuple], entries: range) -> dict:
    """Counts of rows (turn, role, text, fault) in order, and the ways through them from each entry state."""
    turns = [r[0] for r in rows if r[0] is not None]
    s = {"n": len(rows), "blank": 0, "duplicate": 0, "truncated": 0,
         "illegal": sum(_illegal(x[1], y[1]) for x, y in zip(rows, rows[1:])),
         "first_role": rows[0][1] if rows else "", "last_role": rows[-1][1] if rows else "",
         "turns": len(set(turns)), "first_turn": min(turns, default=None), "last_turn": max(turns, default=None)}
    for r in rows:
        if r[3] != "-":
            s[{"b": "blank", "d": "duplicate", "t": "truncated"}[r[3]]] += 1
    cost, order = [], []
    for entry in range(4):
        if entry in entries:
            w = Survivors(entry)
            for _, role, _, f in rows:
                w.step(_initial(role), f in "bd", f == "t")
            cost += w.cost
            order += w.order()
        else:
            cost += [FAR] * 4
            order += range(4)
    return s | {"cost": cost, "way": order, "exit": exit_state(cost[:4], order[:4])}


def joined(parts: list[dict]) -> dict:
    """The summary of consecutive stretches, from theirs."""
    out = None
    for p in parts:
        if out is None or p["n"] == 0 or out["n"] == 0:
            out = p if out is None or out["n"] == 0 else out
            continue
        o = dict(out)
        for k in ("n", "blank", "duplicate", "truncated"):
            o[k] += p[k]
        o["illegal"] += p["illegal"] + _illegal(out["last_role"], p["first_role"])
        o["last_role"] = p["last_role"]
        if p["first_turn"] is not None:
            same = out["last_turn"] is not None and out["last_turn"] == p["first_turn"]
            o["turns"] = out["turns"] + p["turns"] - same
            o["first_turn"] = p["first_turn"] if out["first_turn"] is None else out["first_turn"]
            o["last_turn"] = p["last_turn"]
        o["cost"], o["way"] = [], []
        for entry in range(4):
            mid_cost, mid_order = out["cost"][4 * entry:4 * entry + 4], list(out["way"][4 * entry:4 * entry + 4])
            via = [_via(mid_cost, mid_order, p["cost"], to) for to in range(4)]
            o["cost"] += [FAR if m is None else mid_cost[m] + p["cost"][4 * m + to] for to, m in enumerate(via)]
            o["way"] += sorted(range(4), key=lambda to: (4, 0, to) if via[to] is None else (
                mid_order.index(via[to]), list(p["way"][4 * via[to]:4 * via[to] + 4]).index(to), to))
        o["exit"] = exit_state(o["cost"][:4], o["way"][:4])
        out = o
    return out


def _via(mid_cost, mid_order, cost, to: int) -> int | None:
    """The state between two stretches on the best way to ``to``."""
    ways = [(mid_cost[m] + cost[4 * m + to], mid_order.index(m), m) for m in range(4)
            if mid_cost[m] < FAR and cost[4 * m + to] < FAR]
    return min(ways)[2] if ways else None


def between(parts: list[dict], entry: int, exit_: int) -> list[tuple[int, int]]:
    """(state before, state after) of consecutive stretches on the best way from ``entry`` to ``exit_``."""
    cost, order, back = [FAR] * 4, list(range(4)), []
    cost[entry] = 0
    for p in parts:
        if p["n"] == 0:
            back.append(list(range(4)))
            continue
        via = [_via(cost, order, p["cost"], to) for to in range(4)]
        order = sorted(range(4), key=lambda to: (4, 0, to) if via[to] is None else (
            order.index(via[to]), list(p["way"][4 * via[to]:4 * via[to] + 4]).index(to), to))
        cost = [FAR if m is None else cost[m] + p["cost"][4 * m + to] for to, m in enumerate(via)]
        back.append(via)
    states = [exit_]
    for via in reversed(back):
        states.append(via[states[-1]])
    states.reverse()
    return list(zip(states[:-1], states[1:]))


def repaired(rows: list[tuple], entry: int, exit_: int, close: bool) -> tuple[str, list[tuple[str, str]]]:
    """(edits, repaired (role, text) rows) of the best way through ``rows``; ``close``: they end the conversation."""
    w, edits = Survivors(entry), []
    for _, role, _, f in rows:
        edits += w.step(_initial(role), f in "bd", f == "t")
    edits += w.finish(exit_)
    out, state = [], entry
    for (_, role, text, _), e in zip(rows, edits, strict=True):
        for op in e:
            if op == "D":
                continue
            if op == "K" and role[:1] == "s":
                state = SYSTEM
            else:
                state = _NEXT[state]
            out.append(("", "") if op == "I" else (role, text) if op == "K" else (ROLE[state], text))
            if op == "I":
                out[-1] = (ROLE[state], "")
    if close:
        e = CLOSE[exit_][1]
        edits.append(e)
        for _ in e:
            state = _NEXT[state]
            out.append((ROLE[state], ""))
    return "".join(edits), out


def _line(rows: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in rows)


# --- the Spark side -------------------------------------------------------------------------------------------

#: What a summary holds; ``way``: for each state at the start, the states at the end in the order of their ways' texts.
_SUMMARY = ("n long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, "
            "turns long, first_turn long, last_turn long, cost array<long>, way array<int>, exit int")
_FIELDS = [f.split()[0] for f in _SUMMARY.split(", ")]
_ITEMS = "array<struct<turn:bigint,role:string,text:string,fault:string>>"
_PIECES = f"conv_id {{id}}, part long, seq long, whole boolean, {_SUMMARY}, items {_ITEMS}, audit string, repaired_sha256 string"
_REPAIRED = f"conv_id {{id}}, part long, seq long, audit string, items {_ITEMS}, line string"
_RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after the damage by crc32 of ``conv_id:turn`` modulo 20, nulls as one
    space throughout: 0 drops a row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes it the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    copies = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), h.alias("h"))
            .where("h <> 0")
            .select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", ""))
                    .otherwise(F.col("text")).alias("text"), F.explode(copies).alias("copy")).drop("copy"))


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def _items(rows: list[tuple[str, str]]) -> list[dict]:
    return [{"turn": None, "role": role, "text": text, "fault": None} for role, text in rows]


def _cut(schema: pa.Schema, texts: bool):
    """Sorted rows of a partition -> one finished piece for each conversation that lies whole in it (with its
    repaired messages if ``texts``), several bounded open ones for those that are longer or may go on in a neighbour."""
    def run(batches):
        part = TaskContext.get().partitionId()
        held: list[dict] = []

        def record(conv, seq, rows, whole):
            s = summary(rows, range(1) if whole else range(4))
            r = {"conv_id": conv, "part": part, "seq": seq, "whole": whole, **s}
            if whole:
                r["audit"], got = repaired(rows, EMPTY, s["exit"], True)
                r["repaired_sha256"] = hashlib.sha256(_line(got).encode()).hexdigest()
                r["items"] = _items(got) if texts else []
            else:
                r["items"] = [dict(zip(("turn", "role", "text", "fault"), row)) for row in rows]
            held.append(r)

        conv, seq, rows, chars, begun, known, marked = None, 0, [], 0, False, False, None
        for b in batches:
            for tag, c, turn, role, text, rid in zip(*(b.column(i).to_pylist() for i in range(6))):
                if not begun or c != conv:
                    if begun:                    # complete if its start was seen and it fits a piece: another follows
                        record(conv, seq, rows, known and seq == 0)
                    conv, seq, rows, chars, begun, known = c, 0, [], 0, True, tag == 0
                if tag == 0:
                    continue
                if tag == 1:
                    marked = rid
                    continue
                if rows and (len(rows) >= PIECE_ROWS or chars + len(text) > PIECE_CHARS):
                    record(conv, seq, rows, False)
                    seq, rows, chars = seq + 1, [], 0
                rows.append((turn, role, text, fault(text, marked != rid)))
                chars += len(text)
                if chars > PIECE_CHARS or len(held) >= 256:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held.clear()
        if begun:
            record(conv, seq, rows, False)       # it may go on in the next partition
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return run


def pieces(rows: DataFrame, ids: DataFrame, texts: bool = True) -> DataFrame:
    """Conversations of ``rows`` (conv_id, turn, role, text) as summed-up pieces in order, one at least for
    every conv_id of ``ids``. Order: turn, nulls first; then role and text, of which 32 characters
    and then a digest decide; equal rows are alike. Null roles and texts count as one space."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    # one id per row, written once: the marks below must name the same rows
    rows = kept(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), one("role"), one("text"))
                .withColumn("digest", F.md5("text")).withColumn("rid", F.monotonically_increasing_id()),
                "conversation-rows")
    begins = F.substring("text", 1, 32)
    first = (rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
             .groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn", "rid")).alias("m"), F.min(begins).alias("begins"))
             .select(F.lit(1).alias("tag"), "conv_id", "m.turn", "role", "m.rid", "begins", "digest"))
    said = rows.select(F.lit(2).alias("tag"), "conv_id", "turn", "role", "text", "rid", begins.alias("begins"), "digest")
    start = ids.select(F.lit(0).alias("tag"), "conv_id").distinct()
    key = ["conv_id", "turn", "role", "begins", "digest", "rid"]
    dealt = (said.unionByName(first, allowMissingColumns=True).unionByName(start, allowMissingColumns=True)
             .repartitionByRange(*key).sortWithinPartitions(*key, "tag"))
    ddl = _PIECES.format(id=kind)
    return kept(dealt.select("tag", "conv_id", "turn", "role", "text", "rid").mapInArrow(_cut(_arrow(ddl), texts), ddl),
                "conversation-pieces")


def _levels(open_pieces: DataFrame, kind: str) -> tuple[list[DataFrame], DataFrame]:
    """Summaries by partition, by ever wider stretches of partitions, and one per conversation."""
    schema = f"conv_id {kind}, node long, {_SUMMARY}"
    arrow = _arrow(schema)

    def join_up(t: pa.Table) -> pa.Table:
        parts = sorted(t.to_pylist(), key=lambda r: r["place"])
        top = joined([{f: r[f] for f in _FIELDS} for r in parts])
        return pa.Table.from_pylist([{"conv_id": parts[0]["conv_id"], "node": parts[0]["node"], **top}], schema=arrow)

    at = open_pieces.select("conv_id", F.col("part").alias("node"), F.col("seq").alias("place"), *_FIELDS)
    levels = [at]
    bits = int(open_pieces.agg(F.max("part")).first()[0] or 0).bit_length()
    while True:
        up = kept(at.groupBy("conv_id", "node").applyInArrow(join_up, schema), "conversation-stretches")
        if bits <= 0:
            return levels, up
        at = up.select("conv_id", F.shiftright("node", FAN_BITS).alias("node"), F.col("node").alias("place"), *_FIELDS)
        levels.append(at)
        bits -= FAN_BITS


def _states(levels: list[DataFrame], top: DataFrame, kind: str) -> DataFrame:
    """(conv_id, part, seq, entry, exit, last) of every open piece, from the top level down."""
    schema = f"conv_id {kind}, node long, place long, entry int, exit int, last boolean"
    arrow = _arrow(schema)

    def hand_down(t: pa.Table) -> pa.Table:
        parts = sorted(t.to_pylist(), key=lambda r: r["place"])
        found = between([{f: r[f] for f in _FIELDS} for r in parts], parts[0]["from"], parts[0]["to"])
        return pa.Table.from_pylist([
            {"conv_id": r["conv_id"], "node": r["node"], "place": r["place"], "entry": x, "exit": y,
             "last": r["last"] and r is parts[-1]} for r, (x, y) in zip(parts, found, strict=True)], schema=arrow)

    states = top.select("conv_id", "node", F.lit(EMPTY).alias("from"), F.col("exit").alias("to"), F.lit(True).alias("last"))
    for level in reversed(levels):
        a, b = level.alias("a"), states.alias("b")
        both = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.node") == F.col("b.node")))
        found = both.select("a.*", "b.from", "b.to", "b.last").groupBy("conv_id", "node").applyInArrow(hand_down, schema)
        states = found.select("conv_id", F.col("place").alias("node"), F.col("entry").alias("from"),
                              F.col("exit").alias("to"), "last")
    return found.select("conv_id", F.col("node").alias("part"), F.col("place").alias("seq"), "entry", "exit", "last")


def _emit(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                out = []
                for r in b.slice(lo, 64).to_pylist():
                    rows = [(x["turn"], x["role"], x["text"], x["fault"]) for x in r["items"]]
                    audit, got = repaired(rows, r["entry"], r["exit"], r["last"])
                    out.append({"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "audit": audit,
                                "items": _items(got), "line": _line(got) if got else None})
                yield pa.RecordBatch.from_pylist(out, schema=schema)
    return run


def solved(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The open conversations of ``pieces`` solved together: one summary each, and their repaired pieces (audit,
    items, their lines). No task holds more than a piece of one, or FAN_BITS bits of its summaries."""
    kind = cut.schema["conv_id"].dataType.simpleString()
    left = cut.where("not whole")
    levels, top = _levels(left, kind)
    p, s = left.alias("p"), kept(_states(levels, top, kind), "piece-states").alias("s")
    todo = p.join(s, (F.col("p.part") == F.col("s.part")) & (F.col("p.seq") == F.col("s.seq"))
                  & F.col("p.conv_id").eqNullSafe(F.col("s.conv_id"))).select(
        "p.conv_id", "p.part", "p.seq", "p.items", "s.entry", "s.exit", "s.last")
    ddl = _REPAIRED.format(id=kind)
    return top, todo.mapInArrow(_emit(_arrow(ddl)), ddl)


def _faults(sums: DataFrame) -> DataFrame:
    closing = F.element_at(F.array(*[F.lit(CLOSE[s][0]) for s in range(4)]), F.col("exit") + 1)
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0).cast("long"))
    return sums.withColumn("gaps", gaps).withColumn("cost", F.element_at("cost", F.col("exit") + 1) + closing)


def repaired_messages(rows: DataFrame) -> DataFrame:
    """The repaired conversations of ``rows`` (conv_id, turn, role, text): (conv_id, place, role, text), ``place`` a
    struct that orders the messages of a conversation. Conversations that repair empties have none."""
    cut = pieces(rows, rows)
    _, done = solved(cut)
    both = cut.where("whole").select("conv_id", "part", "seq", "items").unionByName(
        done.select("conv_id", "part", "seq", "items"))
    return both.select("conv_id", "part", "seq", F.posexplode("items").alias("at", "m")).select(
        "conv_id", F.struct("part", "seq", "at").alias("place"), "m.role", "m.text")


def repair_digests(conversations: DataFrame) -> DataFrame:
    """Per original conv_id of ``conversations`` (null is one, too): gaps, blank, duplicate, truncated, illegal, cost,
    audit and repaired_sha256 of the damaged conversation; one without rows left has zeros, '' and the empty
    text's hash. Null roles and texts count as one space, an empty role has no initial and cannot be kept, other
    columns are left out, an empty table gives none.

    A digest is taken over a whole conversation in order, as SHA-256 asks: the repaired pieces of one in
    several pieces pass one task one by one."""
    cut = pieces(damaged(conversations), conversations, texts=False)
    kind = cut.schema["conv_id"].dataType.simpleString()
    top, done = solved(cut)
    ddl = f"conv_id {kind}, audit string, repaired_sha256 string"
    schema = _arrow(ddl)

    def digest(batches):
        conv, begun, sha, audit, lines = None, False, None, [], 0
        held: list[dict] = []
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                for c, a, line in zip(*(x.to_pylist() for x in b.slice(lo, 64).columns)):
                    if not begun or c != conv:
                        if begun:
                            held.append({"conv_id": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()})
                        conv, begun, sha, audit, lines = c, True, hashlib.sha256(), [], 0
                    if line is not None:
                        sha.update((("\n" if lines else "") + line).encode())
                        lines += 1
                    audit.append(a)
                if len(held) >= 256:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held = []
        if begun:
            held.append({"conv_id": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()})
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    digests = (done.select("conv_id", "audit", "line", "part", "seq").repartition("conv_id")
               .sortWithinPartitions("conv_id", "part", "seq").select("conv_id", "audit", "line").mapInArrow(digest, ddl))
    f, d = _faults(top).alias("f"), digests.alias("d")
    several = f.join(d, F.col("f.conv_id").eqNullSafe(F.col("d.conv_id"))).select("f.*", "d.audit", "d.repaired_sha256")
    return _faults(cut.where("whole")).select(_RESULT).unionByName(several.select(_RESULT))
