"""Mixing sources to target weights by distributed prefix sums.

Each document gets a hash-random key. Keys fall into a fixed number of equal
ranges per source, so the sort of a source is spread over its ranges whatever
share of the rows it has. Word counts are summed per (source, range); running
sums over that small table find the one range of each source in which its
budget ends, and only the rows of those ranges are sorted one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from horosphere.llm.tables import kept

KEY_BITS = 52
RANGE_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"


def _keyed(docs: DataFrame, own: list[str], seed: int) -> DataFrame:
    """(doc, doc_id, source, size, key, range): the key depends on doc_id and seed
    alone; ``doc`` holds the columns ``own`` as they are, whatever their names."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    key = F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc"), "doc_id", "source",
                       F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       key.alias("key"))
    return rows.withColumn("range", F.shiftright("key", KEY_BITS - RANGE_BITS).cast("int"))


def targets(sums: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, size) sums.

    Sources in code point order (null last) take the weights in turn and share
    ``share`` times all words; no target passes ``most`` times its source's
    words. Resharing the excess until none is above ends at one level: target =
    min(cap, level * weight). Sources sorted by cap / weight reach their caps in
    that order, so the level comes from running sums over the source table.
    """
    s = sums.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    s = s.withColumn("full_at", F.col("cap") / F.col("weight"))
    up = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    on = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = (s.withColumn("level", (F.lit(share) * F.sum("source_size").over(whole)
                                - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("weight").over(on))
         .withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at") * (1 + 1e-12), F.struct("full_at", "level")))
                     .over(whole)["level"]))
    return s.select("source", "source_size",
                    F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.lit(0.0)).alias("target"))


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 0) -> DataFrame:
    """All columns of ``docs`` plus size, source_size, target and taken.

    ``taken`` counts the words of the document in the mix: whole epochs of the
    source first, then its documents in key order up to the exact budget (the
    last one in part). Null texts have size 0; null sources are one source;
    rows that repeat a doc_id are counted one by one; an empty table gives no
    rows. Columns of these names in ``docs`` are replaced.
    """
    mine = ["size", "source_size", "target", "taken"]
    own = [c for c in docs.columns if c not in mine]
    rows = _keyed(docs, own, seed)
    sums = kept(rows.groupBy("source", "range").agg(F.sum("size").alias("size")), "range-sums")
    to = targets(sums, weights, share, most).withColumn("budget", F.floor("target")) \
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))) \
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    run = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("upto", F.sum("size").over(run)).withColumnRenamed("source", "s") \
        .join(to, F.col("s").eqNullSafe(F.col("source")))
    cut = kept(ends.groupBy(F.col("s"), "source_size", "target", "epochs", "rest").agg(
        F.min(F.when(F.col("upto") > F.col("rest"), F.col("range"))).alias("cut"),
        F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("before")), "cuts")
    placed = rows.join(cut, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.col("epochs") * F.col("size")
    clear = placed.where("cut is null or range <> cut").withColumn(
        "taken", whole + F.when(F.col("range") < F.coalesce("cut", F.lit(1 << RANGE_BITS)), F.col("size")).otherwise(0))
    inner = Window.partitionBy("source").orderBy("key", "doc_id", "size") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_cut = placed.where("range = cut").withColumn("upto", F.sum("size").over(inner))
    left = F.col("rest") - F.coalesce("before", F.lit(0)) - (F.col("upto") - F.col("size"))
    at_cut = at_cut.withColumn("taken", whole + F.greatest(F.lit(0), F.least(F.col("size"), left)))
    cols = ["doc.*"] + mine
    return clear.select(cols).unionByName(at_cut.select(cols))
