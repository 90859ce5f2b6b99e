"""C2 on a stream: k-means whose centres forget.

Every micro-batch is assigned to the centres that the batch before it left, and each centre moves to the mean of
what it stood for so far, its weight decayed, and its new rows. The centres of every batch are a small table of their
own, written over when a batch is replayed, so a restart carries on from the last finished batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horosphere.functions import hyperbolic as H
from horosphere.operators.clustering import assign_nearest, centroids, start_centers

CENTERS = "cluster long, center array<double>, weight double"


def decayed_step(batch: DataFrame, centers: DataFrame, vec: str = "vec", decay: float = 1.0, unit: str = "batches",
                 metric: str = "euclidean", c: float = 1.0) -> DataFrame:
    """Centres ``(cluster, center, weight)`` after the rows of ``batch``.

    With m rows of mean x nearest to a centre of weight w, the centre becomes (w d center + m x) / (w d + m) and its
    weight w d + m. d is ``decay`` (``unit='batches'``: 1 keeps all of the past, 0 only the new rows) or ``decay`` to
    the power of the batch's rows (``unit='points'``). A centre without rows stays where it is and its weight decays.
    ``metric='poincare'`` pulls the means inside the ball. Null vectors are left out."""
    rows = batch.where(F.col(vec).isNotNull()).select(vec)
    own = assign_nearest(rows, centers, vec, metric=metric, c=c, out="cluster")
    means = centroids(own, vec, ["cluster"]).select("cluster", F.col("center").alias("_m"), F.col("size").alias("_n"))
    if unit == "batches":
        factor = F.lit(float(decay))
        got = centers.join(means, "cluster", "left")
    elif unit == "points":
        factor = F.pow(F.lit(float(decay)), F.coalesce("_all", F.lit(0)))
        got = centers.join(means, "cluster", "left").crossJoin(F.broadcast(means.agg(F.sum("_n").alias("_all"))))  # one row
    else:
        raise ValueError(f"unknown unit {unit!r}")
    got = got.withColumn("_w", F.col("weight") * factor)
    moved = F.zip_with("center", "_m", lambda a, b: (a * F.col("_w") + b * F.col("_n")) / (F.col("_w") + F.col("_n")))
    if metric == "poincare":
        moved = H.clamp_to_ball(moved, c)
    return got.select("cluster", F.when(F.col("_n").isNull(), F.col("center")).otherwise(moved).alias("center"),
                      (F.col("_w") + F.coalesce("_n", F.lit(0))).alias("weight"))


def _handler(workdir: str, start: DataFrame | None, k: int | None, vec: str, id_col: str, decay: float, unit: str,
             metric: str, c: float, seed: int):
    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if epoch:
            old = spark.read.schema(CENTERS).parquet(f"{workdir}/centers/epoch={epoch - 1}")
        elif start is not None:
            old = start.select(F.col("cluster").cast("long").alias("cluster"), "center", F.col("weight").cast("double").alias("weight"))
        else:
            old = spark.createDataFrame([], CENTERS)
        batch = batch.persist()
        if k is not None and (have := old.count()) < k:
            more = start_centers(batch.where(F.col(vec).isNotNull()), k - have, vec, id_col, seed, metric, c)
            old = old.unionByName(more.select((F.col("cluster") + have).alias("cluster"), "center", F.lit(0.0).alias("weight")))
        decayed_step(batch, old, vec, decay, unit, metric, c).write.mode("overwrite").parquet(f"{workdir}/centers/epoch={epoch}")
        batch.unpersist()
    return run


def stream_kmeans(stream: DataFrame, workdir: str, start: DataFrame | None = None, k: int | None = None, vec: str = "vec",
                  id_col: str = "msg_id", decay: float = 1.0, unit: str = "batches", metric: str = "euclidean",
                  c: float = 1.0, seed: int = 42):
    """C2 on a stream: ``decayed_step`` for every micro-batch; returns the streaming query handle.

    ``start`` ``(cluster, center, weight)`` gives the first centres, or k-means|| picks ``k`` of the first batch with
    rows (weight 0; while a batch has too few, the next one adds what is missing). ``workdir`` is shared
    storage: ``centers/epoch=<id>`` holds the centres after each batch."""
    if (start is None) == (k is None):
        raise ValueError("give either start or k")
    return (stream.writeStream.option("checkpointLocation", f"{workdir}/ckpt")
            .foreachBatch(_handler(workdir, start, k, vec, id_col, decay, unit, metric, c, seed))
            .trigger(availableNow=True).start())


def stream_centers(spark: SparkSession, workdir: str) -> DataFrame:
    """The centres after the last batch of ``stream_kmeans``."""
    every = spark.read.schema(CENTERS + ", epoch long").parquet(f"{workdir}/centers")
    last = every.agg(F.max("epoch")).first()[0]
    return every.where(F.col("epoch") == F.lit(last)).drop("epoch")
