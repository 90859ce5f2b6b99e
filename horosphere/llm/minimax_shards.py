"""Sharding by a minimax contiguous partition of atomic groups.

Equal texts form one atomic group; groups are ordered by the SHA-256 of the text. The
smallest capacity with which a greedy pass needs at most ``shards`` shards is
found by binary search and the shards are cut there. The driver never sees the
groups: it works on byte sums of digest prefixes (4096 at first). An optimistic
pass lets a prefix be cut anywhere, a pessimistic one nowhere; together they
bound the capacity, and only prefixes in which a cut can fall for a capacity
between the bounds (a few per shard) are opened by two more digits, until both
bounds agree. That capacity is exact for the groups.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from horosphere.llm.tables import kept

FIRST_DIGITS = 3     # hex digits of the first prefixes: 16**3 sums
MORE_DIGITS = 2      # digits by which a prefix is opened
SLOT_PARTS = 4096    # parts of a shard whose rows are numbered on their own


def _sums(rows: DataFrame, digits: int) -> list[tuple[str, int, bool]]:
    """(prefix, bytes, holds one group only) in order; at most one row per prefix."""
    got = rows.groupBy(F.substring("key", 1, digits).alias("p")).agg(
        F.sum("size").alias("s"), (F.min("key") == F.max("key")).alias("one")).collect()
    return sorted((r["p"], r["s"], r["one"]) for r in got)


class Packing:
    """Greedy passes over (prefix, size, atomic) items."""

    def __init__(self, items):
        self.items = items
        self.upto = [0, *accumulate(i[1] for i in items)]
        self.total = self.upto[-1]

    def cuts(self, cap: int, shards: int, fluid: bool) -> list[int]:
        """Item index at which each further shard begins (or, for a fluid pass, in which)."""
        at, out, n = 0, [], len(self.items)       # at: bytes packed so far
        while len(out) < shards:
            i = bisect_right(self.upto, at + cap) - 1
            if i >= n:
                break
            nxt = at + cap if fluid and not self.items[i][2] else self.upto[i]
            if nxt <= at:                          # an item larger than the capacity
                return [*out, *[i] * (shards - len(out))]
            at = nxt
            out.append(i)
        return out

    def fits(self, cap: int, shards: int, fluid: bool) -> bool:
        return len(self.cuts(cap, shards, fluid)) < shards

    def least(self, shards: int, fluid: bool) -> int:
        lo, hi = -(-self.total // shards), max(1, self.total)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.fits(mid, shards, fluid) else (mid + 1, hi)
        return lo


def boundaries(rows: DataFrame, shards: int) -> tuple[int, list[str]]:
    """(smallest capacity, first digest prefix of shards 1, 2, ...) for rows (key, size)."""
    items = _sums(rows, FIRST_DIGITS)
    while True:
        p = Packing(items)
        low, high = p.least(shards, True), p.least(shards, False)
        cuts = p.cuts(high, shards, False)
        if low >= high:
            return high, [items[i][0] for i in cuts]
        early, late = p.cuts(low, shards, False), p.cuts(high, shards, True)
        late += [len(items) - 1] * (len(early) - len(late))
        doubt = {i for a, b in zip(early, late) for i in range(a, min(b, len(items) - 1) + 1)
                 if not items[i][2]}
        doubt |= {i for i in cuts + early + late if i < len(items) and not items[i][2]}
        if not doubt:
            return high, [items[i][0] for i in cuts]
        by_length: dict[int, list[str]] = {}
        for i in doubt:
            by_length.setdefault(len(items[i][0]), []).append(items[i][0])
        opened = []
        for digits, names in by_length.items():
            inside = rows.where(F.substring("key", 1, digits).isin(names))
            opened += _sums(inside, digits + MORE_DIGITS)
        items = sorted([x for i, x in enumerate(items) if i not in doubt] + opened)


def minimax_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    size = UTF-8 bytes of the text (null: none) plus 1; the law is ``bytes``.
    ``slot`` numbers the rows of a shard from 0 without gaps. Null and empty
    texts are one group; repeated rows each have a slot; an empty table gives
    no rows; other columns are ignored. With fewer groups than shards the last
    shards stay empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = kept(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                            F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("key")),
                "sized")
    _, firsts = boundaries(rows.select("key", "size"), shards)
    shard = reduce(lambda a, b: a + b, [(F.col("key") >= b).cast("int") for b in firsts], F.lit(0))
    rows = rows.withColumn("shard", shard).withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SLOT_PARTS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("c")).select(
        "shard", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "key")
    # offsets has at most shards * SLOT_PARTS rows
    return (rows.withColumn("n", F.row_number().over(within) - 1).join(F.broadcast(offsets), ["shard", "part"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("offset") + F.col("n")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
