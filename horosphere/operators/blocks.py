"""Message blocks, labels and positional splits.

Block 0 (``M0``) holds messages earlier than ``min(created_at) + offline_days``
(strict ``<``, not aligned to midnight); later messages get one block per
calendar date that has data, numbered densely from 1 in date order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from horosphere.session import cut_lineage

ORDER = ("created_at", "msg_id")


def assign_blocks(msgs: DataFrame, offline_days: int = 7) -> DataFrame:
    """B1 (+P4): add ``block_id BIGINT``, ``block_name``, ``is_offline``.

    The start time is a one-row aggregate (broadcast, fixed size). Dense day
    numbers come from the distinct dates, a table bounded by the time span in
    days; AQE broadcasts it only when its measured size is under the
    threshold and otherwise keeps a shuffle join.
    """
    t0 = msgs.agg(F.min("created_at").alias("_t0"))
    x = msgs.crossJoin(F.broadcast(t0))
    offline = F.col("created_at") < F.col("_t0") + F.make_dt_interval(days=F.lit(offline_days))
    x = (x.withColumn("is_offline", offline)
         .withColumn("_date", F.when(~F.col("is_offline"), F.to_date("created_at"))))
    dates = (x.where(~F.col("is_offline")).select("_date").distinct()
             .withColumn("block_id", F.dense_rank().over(Window.orderBy("_date")).cast("bigint")))
    out = (x.join(dates, "_date", "left")
           .withColumn("block_id", F.coalesce(F.col("block_id"), F.lit(0).cast("bigint")))
           .withColumn("block_name", F.concat(F.lit("M"), F.col("block_id").cast("string"))))
    return out.drop("_date", "_t0")


def block_stats(blocks: DataFrame, approx: bool = False) -> DataFrame:
    """B2: one row per block; ``approx=True`` swaps in ``approx_count_distinct``."""
    nd = F.approx_count_distinct("event") if approx else F.countDistinct("event")
    return (blocks.groupBy("block_id", "block_name", "is_offline")
            .agg(F.min("created_at").alias("start_ts"), F.max("created_at").alias("end_ts"),
                 F.count(F.lit(1)).alias("num_messages"), nd.alias("num_events")))


def block_sketches(blocks: DataFrame, bits: int = 12) -> DataFrame:
    """B2 in a form that merges: times, messages and an HLL sketch of the events (2**bits registers, relative error
    about 1.04 / 2**(bits / 2), 1.6 % by default) of every block, one row to store per block."""
    return (blocks.groupBy("block_id", "block_name", "is_offline")
            .agg(F.min("created_at").alias("start_ts"), F.max("created_at").alias("end_ts"),
                 F.count(F.lit(1)).alias("num_messages"),
                 F.hll_sketch_agg(F.col("event").cast("string"), bits).alias("events")))


def merged_stats(sketches: DataFrame, *by) -> DataFrame:
    """B2/B3 of any union of stored blocks: start, end and messages exactly, distinct events by merged
    sketches, per value of ``by`` (columns of the stored rows, e.g. the week of ``start_ts``) or in all. No message is read."""
    return (sketches.groupBy(*by)
            .agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"),
                 F.sum("num_messages").alias("num_messages"), F.hll_union_agg("events").alias("events"))
            .withColumn("num_events", F.hll_sketch_estimate("events")).drop("events"))


def table_stats(msgs: DataFrame) -> DataFrame:
    """Messages, distinct events and date range of the whole table."""
    return msgs.agg(F.count(F.lit(1)).alias("num_messages"),
                    F.countDistinct("event").alias("num_events"),
                    F.min("created_at").alias("first_ts"), F.max("created_at").alias("last_ts"))


def block_and_table_stats(blocks: DataFrame) -> DataFrame:
    """B2 and B3 in one aggregation pass (``GROUPING SETS ((block_id), ())``).

    ``scope`` is ``'block'`` or ``'total'``; the total row has ``block_id`` -1.
    """
    g = (blocks.groupingSets([["block_id"], []], "block_id")
         .agg(F.grouping_id().alias("_gid"),
              F.min("created_at").alias("start_ts"), F.max("created_at").alias("end_ts"),
              F.count(F.lit(1)).alias("num_messages"),
              F.countDistinct("event").alias("num_events")))
    return (g.withColumn("scope", F.when(F.col("_gid") == 0, F.lit("block")).otherwise("total"))
            .withColumn("block_id", F.coalesce(F.col("block_id"), F.lit(-1).cast("bigint")))
            .drop("_gid"))


def get_block(blocks: DataFrame, name: str) -> DataFrame:
    """P5: one block by name (prunes partitions when stored by ``block_id``)."""
    if not (name.startswith("M") and name[1:].isdigit()):
        return blocks.where(F.col("block_name") == name)
    return blocks.where(F.col("block_id") == int(name[1:]))


def encode_labels(df: DataFrame, group: str | None = "block_id", col: str = "event",
                  out: str = "label_id", fit_on: DataFrame | None = None) -> DataFrame:
    """Contiguous ids ``0..k-1`` by sorted label, per group.

    Ranks only the distinct ``(group, label)`` set, then joins it back
    (AQE broadcasts it when small). ``fit_on`` gives the rows whose labels
    define the ids (e.g. train UNION val); default: ``df`` itself.
    """
    keys = [group] if group else []
    src = (fit_on if fit_on is not None else df).select(*keys, col).distinct()
    w = Window.partitionBy(*keys).orderBy(col) if keys else Window.orderBy(col)
    ids = src.withColumn(out, (F.dense_rank().over(w) - 1).cast("bigint"))
    return df.join(ids, keys + [col], "left")


# ---------------------------------------------------------------- splits

def _positions(keys: DataFrame, order: tuple, num_partitions: int) -> DataFrame:
    """Global 0-based position of every key row under ``order``.

    Range partitioning puts a contiguous key range in each partition and the
    partition is sorted; ``monotonically_increasing_id`` then encodes
    (partition index << 33) + position inside that sorted partition, which
    is deterministic here (the same sorted rows on every retry). A small
    table with one row per partition turns local positions into global ones.
    All on the JVM; only the key columns move and are checkpointed.
    """
    r = (keys.repartitionByRange(num_partitions, *order).sortWithinPartitions(*order)
         .withColumn("_mid", F.monotonically_increasing_id()))
    local = (r.withColumn("_pid", F.shiftright("_mid", 33))
             .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
             .drop("_mid"))
    # Range bounds come from sampling rows whose order depends on shuffle
    # fetch order, so two executions may partition differently: write the
    # narrow (key, partition, position) table once and read it twice.
    local = cut_lineage(local)
    sizes = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = sizes.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)))
    return (local.join(F.broadcast(offs.select("_pid", "_off")), "_pid")
            .withColumn("_gpos", F.col("_off") + F.col("_local"))
            .drop("_pid", "_off", "_local"))


def positional_split(df: DataFrame, cuts: tuple[float, ...], names: tuple[str, ...],
                     group: str = "block_id", order: tuple = ORDER,
                     strategy: str = "range", num_partitions: int | None = None) -> DataFrame:
    """``split`` column from positions inside each group.

    Row ``i`` (0-based, ordered by ``order``) of a group with ``n`` rows is in
    part ``j`` when ``cast(n*cuts[j-1] as bigint) <= i < cast(n*cuts[j] as
    bigint)``; the cuts are double literals, so the float truncation matches
    ``int(n * r)`` (``n=10`` with 70/10/20 gives 7/0/3).

    ``strategy='range'`` never puts a whole group in one task: positions are
    computed on the key columns only, the key at each cut is found, and the
    data is compared with those few boundary keys (one row per group). ``strategy='window'`` is the plain ``row_number`` form.
    """
    assert len(names) == len(cuts) + 1
    cut_cols = [f"_cut{j}" for j in range(len(cuts))]

    def label(pos_ok):
        expr = F.lit(names[-1])
        for j in reversed(range(len(cuts))):
            expr = F.when(pos_ok(j), F.lit(names[j])).otherwise(expr)
        return expr

    if strategy == "window":
        w = Window.partitionBy(group).orderBy(*order)
        x = (df.withColumn("_i", F.row_number().over(w) - 1)
             .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(group))))
        for j, c in enumerate(cuts):
            x = x.withColumn(cut_cols[j], (F.col("_n") * F.lit(float(c))).cast("bigint"))
        return x.withColumn("split", label(lambda j: F.col("_i") < F.col(cut_cols[j]))) \
                .drop("_i", "_n", *cut_cols)

    spark = df.sparkSession
    nparts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(group, *order)
    pos = _positions(keys, (group, *order), nparts)   # a group's positions are consecutive
    meta = pos.groupBy(group).agg(F.min("_gpos").alias("_start"), F.count(F.lit(1)).alias("_n"))
    def cut_at(c):
        k = (F.col("_n") * F.lit(float(c))).cast("bigint")
        return F.when(k < F.col("_n"), F.col("_start") + k)

    targets = meta.select(group, *[cut_at(c).alias(cut_cols[j]) for j, c in enumerate(cuts)])
    # key found at each cut position (NULL when the cut is at or past the end)
    bounds = targets
    for j, cc in enumerate(cut_cols):
        at = pos.select(F.col("_gpos").alias(cc), F.struct(*order).alias(f"_k{j}"))
        bounds = bounds.join(at, cc, "left")
    bounds = bounds.select(group, *[f"_k{j}" for j in range(len(cuts))])
    key = F.struct(*order)
    x = df.join(bounds, group, "left")
    out = x.withColumn("split", label(
        lambda j: F.col(f"_k{j}").isNull() | (key < F.col(f"_k{j}"))))
    return out.drop(*[f"_k{j}" for j in range(len(cuts))])


def split_config(df: DataFrame, train: float = 0.7, val: float = 0.1, **kw) -> DataFrame:
    """Loader split, cuts ``train`` and ``train + val`` (70/10/20)."""
    return positional_split(df, (train, train + val), ("train", "val", "test"), **kw)


def split_70_20_10(df: DataFrame, **kw) -> DataFrame:
    """The experiments' split (cuts 0.7 and 0.9)."""
    return positional_split(df, (0.7, 0.9), ("train", "val", "test"), **kw)


def split_80_20(df: DataFrame, **kw) -> DataFrame:
    """One cut at 0.8 (ablation's Euclidean path)."""
    return positional_split(df, (0.8,), ("train", "test"), **kw)


def prepare_block(blocks: DataFrame) -> DataFrame:
    """P1+P2: text, time and contiguous label per block."""
    return encode_labels(blocks.select("msg_id", "block_id", "text", "created_at", "event"))
