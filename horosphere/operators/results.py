"""Result tables (R1-R12): a long metric table and its summaries.

Runs, blocks and epochs are rows of one table
``(experiment, config, run, block_id, block_name, epoch, phase, metric, value)``
(any subset of the key columns); every summary is a group-by over it.
Standard deviations are population (``stddev_pop``), as in numpy.
"""

from __future__ import annotations

import json
import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from horosphere.functions.vectors import col_

METRIC_SCHEMA = T.StructType([
    T.StructField("experiment", T.StringType()), T.StructField("config", T.StringType()),
    T.StructField("run", T.LongType()), T.StructField("block_name", T.StringType()),
    T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())])


def add_run(results: DataFrame | None, metrics: DataFrame) -> DataFrame:
    """Append a run's long rows (``unionByName``; missing columns NULL)."""
    if results is None:
        return metrics
    return results.unionByName(metrics, allowMissingColumns=True)


def mean_std(results: DataFrame, keys: list[str] | tuple = ("metric",)) -> DataFrame:
    """Mean and population std of ``value`` over the other keys.

    Metrics absent from the table simply have no row (the ``(0, 0)``
    default of a missing metric is applied by ``summary``).
    """
    return results.groupBy(*keys).agg(F.avg("value").alias("mean"),
                                       F.stddev_pop("value").alias("std"),
                                       F.count(F.lit(1)).alias("n"))


def summary(results: DataFrame, metrics: tuple = ("nmi", "ami")) -> DataFrame:
    """``(metric, mean, std)`` for the given metrics, 0/0 for missing ones."""
    spark = results.sparkSession
    wanted = spark.createDataFrame([(m,) for m in metrics], "metric string")
    ms = mean_std(results.where(F.col("metric").isin(list(metrics))))
    return (wanted.join(ms, "metric", "left")
            .select("metric", F.coalesce("mean", F.lit(0.0)).alias("mean"),
                    F.coalesce("std", F.lit(0.0)).alias("std")))


def block_order(name) -> Column:
    """Numeric part of a block name (``M12`` -> 12); non-numeric -> 0."""
    rest = F.substring(col_(name), 2, 1 << 20)
    return F.when(rest.rlike(r"^[0-9]+$"), rest.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def block_table(results: DataFrame, metrics: tuple = ("nmi", "ami")) -> DataFrame:
    """One row per block with ``<metric>_mean`` / ``<metric>_std``,
    ordered by the number in the block name."""
    ms = mean_std(results.where(F.col("metric").isin(list(metrics))), ["block_name", "metric"])
    aggs = []
    for m in metrics:
        aggs += [F.first(F.when(F.col("metric") == m, F.col("mean")), True).alias(f"{m}_mean"),
                 F.first(F.when(F.col("metric") == m, F.col("std")), True).alias(f"{m}_std")]
    t = ms.groupBy("block_name").agg(*aggs)
    return t.withColumn("block_order", block_order("block_name")).orderBy("block_order",
                                                                          "block_name")


def format_paper_style(mean, std) -> Column:
    """``.NN+-.NN`` with truncation toward zero (1.0 -> ``.100``)."""
    m = (col_(mean) * F.lit(100.0)).cast("int")
    s = (col_(std) * F.lit(100.0)).cast("int")
    return F.format_string(".%02d±.%02d", m, s)


def log_epoch(history: DataFrame | None, epoch_rows: DataFrame) -> DataFrame:
    """Append ``(epoch, phase, metric, value)`` rows."""
    return epoch_rows if history is None else history.unionByName(epoch_rows)


def best_epoch(history: DataFrame, metric: str = "nmi", phase: str = "val") -> DataFrame:
    """The epoch with the highest value of ``metric`` in ``phase``;
    the first such epoch wins ties. Empty when nothing matches."""
    h = history.where((F.col("phase") == phase) & (F.col("metric") == metric))
    best = h.agg(F.max_by(F.struct("epoch", "value"),
                          F.struct(F.col("value"), -F.col("epoch"))).alias("_b"))
    return best.where(F.col("_b").isNotNull()).select("_b.epoch", "_b.value")


def two_level_mean(results: DataFrame, inner: str = "run", keys: list[str] | tuple = ("metric",)
                   ) -> DataFrame:
    """Mean over blocks within each ``inner`` unit, then mean/std over units."""
    per = results.groupBy(inner, *keys).agg(F.avg("value").alias("value"))
    return mean_std(per, keys)


def compare(results: DataFrame, by: str = "config", metrics: tuple = ("nmi", "ami"),
            order: list | None = None) -> DataFrame:
    """One row per configuration, one column per metric (mean)."""
    t = (results.where(F.col("metric").isin(list(metrics))).groupBy(by)
         .pivot("metric", list(metrics)).agg(F.avg("value")))
    if order:
        pos = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(by))
        t = t.orderBy(pos)
    return t


@contextmanager
def stage_timer(store: list, stage: str):
    """Wall seconds of a stage (around its action) as a metric row."""
    t0 = time.perf_counter()
    try:
        yield
    finally:
        store.append((stage, time.perf_counter() - t0))


def timings_frame(spark: SparkSession, store: list) -> DataFrame:
    return spark.createDataFrame([(f"{s}_time", float(v)) for s, v in store],
                                 "metric string, value double")


def save_results(results: DataFrame, path: str, fmt: str = "json",
                 partition_by: list[str] | None = None) -> None:
    """Write a result table (JSON lines or Parquet, appendable)."""
    w = results.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    getattr(w, fmt)(path)


def nested_summary(results: DataFrame, keys: list[str] | tuple = ("experiment",), config: dict | None = None,
                   run: str = "run") -> DataFrame:
    """S7-S9 shape: one row per ``keys`` with mean/std per metric, all runs and the configuration.

    ``blocks`` holds mean/std per block where the table has a ``block_name``. The runs of one
    experiment are a handful of parameters' worth of rows, so lists are short.
    """
    k = list(keys)
    pair = F.struct("mean", "std")

    def listed(name: str, what: str) -> Column:
        """(name, map) structs ordered by name; maps themselves have no order."""
        at = lambda x, y: F.when(x[name] < y[name], -1).when(x[name] > y[name], 1).otherwise(0)
        return F.array_sort(F.collect_list(F.struct(name, F.col("m").alias(what))), at)

    out = mean_std(results, [*k, "metric"]).groupBy(*k).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", pair.alias("v"))))).alias("summary"))
    if "block_name" in results.columns:
        per = mean_std(results, [*k, "block_name", "metric"]).groupBy(*k, "block_name").agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", pair.alias("v"))))).alias("m"))
        out = out.join(per.groupBy(*k).agg(listed("block_name", "summary").alias("blocks")), k)
    if run in results.columns:
        per = results.groupBy(*k, run, "metric").agg(F.avg("value").alias("value")).groupBy(*k, run).agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("m"))
        out = out.join(per.groupBy(*k).agg(listed(run, "metrics").alias("runs")), k)
    return out.withColumn("config", F.lit(json.dumps(config or {}, sort_keys=True, default=str)))


def save_summary(results: DataFrame, path: str, config: dict | None = None,
                 keys: list[str] | tuple = ("experiment",)) -> None:
    """S7 (offline), S8 (online, with blocks), S9 (ablation: keys experiment and config name) as JSON lines."""
    nested_summary(results, keys, config).write.mode("append").json(path)
