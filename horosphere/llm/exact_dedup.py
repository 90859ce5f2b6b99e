"""Exact duplicates with a heavy-hitter split.

A Misra-Gries type sketch (``approx_top_k``: the frequent-items sketch of
counters that are decremented together) names the digests that can be frequent.
It is built per task and merged in two steps. Their true count and winner
are then counted over all rows; that table has at most ``top`` rows, so it is
broadcast and settles every copy of a frequent text where the row is read.
All other digests go through one ordinary shuffle. Which digests the sketch
names decides only the path a row takes, never the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from horosphere.llm.tables import kept

TOP = 256            # frequent digests settled by broadcast
COUNTERS = 2048      # counters of the sketch
MERGERS = 32         # tasks that merge sketches before the last one does


def frequent(digests: DataFrame, top: int = TOP, counters: int = COUNTERS) -> DataFrame:
    """At most ``top`` candidate digests (column text_sha256) of the rows."""
    counters = max(counters, top)
    part = digests.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("g")).agg(
        F.expr(f"approx_top_k_accumulate(text_sha256, {counters})").alias("s"))
    # grouped, so that a task without sketches has nothing to hand on (an ungrouped one cannot)
    all_ = part.groupBy(F.pmod("g", F.lit(1))).agg(F.expr(f"approx_top_k_combine(s, {counters})").alias("s"))
    return (all_.select(F.explode(F.expr(f"approx_top_k_estimate(s, {top})")).alias("x"))
            .where("x.count > 1").select(F.col("x.item").alias("text_sha256")))


def exact_dedup(docs: DataFrame, top: int = TOP, counters: int = COUNTERS) -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are compared as they are; null counts as empty. Of equal texts the
    row with the largest doc_id stays (a null doc_id is the least); of rows that
    repeat both text and doc_id one stays. Other columns are ignored and an
    empty table gives no rows.
    """
    d = kept(docs.select("doc_id", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
                         .alias("text_sha256")), "digests")
    if d.isEmpty():
        return d.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"),
                        F.lit(True).alias("kept"), "text_sha256")
    names = kept(frequent(d, top, counters), "frequent")
    won = kept(d.join(F.broadcast(names), "text_sha256").groupBy("text_sha256").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "winners")
    mark = d.join(F.broadcast(won), "text_sha256", "left")
    hot = mark.where("group_size is not null")
    wins = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    once = Window.partitionBy("text_sha256").orderBy("doc_id")
    best = hot.where(wins).withColumn("kept", F.row_number().over(once) == 1)
    lost = hot.where(~wins).withColumn("kept", F.lit(False))
    by = Window.partitionBy("text_sha256").orderBy(F.col("doc_id").desc_nulls_last())
    rest = (mark.where("group_size is null").select("doc_id", "text_sha256")
            .withColumn("kept", F.row_number().over(by) == 1)
            .withColumn("keep_id", F.first("doc_id").over(by))
            .withColumn("group_size", F.count(F.lit(1)).over(
                by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return rest.select(cols).unionByName(best.select(cols)).unionByName(lost.select(cols))
