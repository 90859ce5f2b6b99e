"""Incremental processing (K1-K5) on Structured Streaming.

* K1 update rule: block ``i`` retrains when ``i % window == 0``; block ids
  are dense, so the block counter is the block id.
* K4 daily blocks on a live stream: event-time windows of one day with a
  watermark; a day is emitted once the watermark passes its end (append
  mode), rows later than the watermark are dropped. Distinct events are counted by one
  state row per (day, event), or kept as a sketch that merges.
* K5 online assignment: new rows go to the current centres (broadcast),
  stateless, so it runs per micro-batch.
* K2/K3 blocks on a stream: a ``foreachBatch`` driver closes M0 and then daily
  blocks in order, and ``IncrementalDetector`` trains, clusters and scores
  them with weights and metrics stored per (run, block).
"""

from __future__ import annotations

from datetime import datetime, time, timedelta
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from horosphere.session import cut_lineage, scratch_path

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def update_flags(blocks: DataFrame, windows=(1, 2, 3, 4, 5, 1000), id_col: str = "block_id"
                 ) -> DataFrame:
    """K1 for every block and window size: ``(block_id, window, update)``."""
    ws = F.array(*[F.lit(int(x)).cast("bigint") for x in windows])
    return (blocks.select(id_col).distinct().withColumn("window", F.explode(ws))
            .withColumn("update", F.pmod(F.col(id_col), F.col("window")) == 0))


def daily_counts(stream: DataFrame, ts_col: str = "ts", key: str = "event_type",
                 delay: str = "1 hour") -> DataFrame:
    """K4: per closed day and key, the number of rows (event-time windows)."""
    x = stream.withColumn("_t", F.col(ts_col).cast("timestamp"))
    return (x.withWatermark("_t", delay)
            .groupBy(F.window("_t", "1 day"), F.col(key))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.to_date(F.col("window.start")).alias("day"), F.col(key), "n"))


def daily_stats(stream: DataFrame, ts_col: str = "ts", event: str = "event_type",
                delay: str = "1 hour", exact: bool = True, id_bits: int = 12) -> DataFrame:
    """K4: first and last time, rows and distinct events of every closed day.

    ``exact``: one state row per (day, event) counts its rows; a second window over those that close gives the day,
    so no state row grows with the number of events. Else a day keeps one HLL sketch of 2**``id_bits`` registers,
    which is the column ``events`` and can be merged later (``blocks.merged_stats``)."""
    x = stream.withColumn("_t", F.col(ts_col).cast("timestamp")).withWatermark("_t", delay)
    first, last = F.min("_t").alias("start_ts"), F.max("_t").alias("end_ts")
    rows = F.count(F.lit(1)).alias("num_messages")
    if exact:
        per = x.groupBy(F.window("_t", "1 day"), F.col(event).alias("_e")).agg(first, last, rows)
        day = per.groupBy(F.window(F.window_time("window"), "1 day").alias("window")).agg(
            F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("num_messages").alias("num_messages"),
            F.count("_e").alias("num_events"))                       # a null event is none
        more = ["num_events"]
    else:
        day = x.groupBy(F.window("_t", "1 day")).agg(
            first, last, rows, F.hll_sketch_agg(F.col(event).cast("string"), id_bits).alias("events"))
        more = [F.hll_sketch_estimate("events").alias("num_events"), "events"]
    return day.select(F.to_date(F.col("window.start")).alias("day"), F.col("start_ts").cast("timestamp_ntz").alias("start_ts"),
                      F.col("end_ts").cast("timestamp_ntz").alias("end_ts"), "num_messages", *more)


def _run_to_table(spark: SparkSession, q: DataFrame, name: str, mode: str = "append") -> DataFrame:
    out = scratch_path(spark, f"{name}-out")
    ck = scratch_path(spark, f"{name}-ckpt")
    h = (q.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
         .outputMode(mode).trigger(availableNow=True).start())
    h.awaitTermination()
    return spark.read.schema(q.schema).parquet(out)


def file_source(spark: SparkSession, folder: str, schema: T.StructType, files: str | None,
            files_per_trigger: int | None = None):
    """File stream of ``folder``, or of what ``files`` names in it: a file, or a table of many files in a
    folder of that name. Event-time windows need an instant: wall-clock (NTZ) times are read in the
    session's time zone, which should be UTC."""
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(f"{folder}/{{{files}}}" if files else folder)      # a stream takes a single file by a pattern only


def stream_daily_counts(spark: SparkSession, folder: str, files: str | None = None,
                        delay: str = "1 hour") -> DataFrame:
    """K4 end to end: stream Parquet files of a folder, write closed days to Parquet."""
    src = file_source(spark, folder, EVENT_SCHEMA, files)
    return _run_to_table(spark, daily_counts(src, delay=delay), "daily")


def stream_daily_stats(spark: SparkSession, folder: str, files: str | None = None,
                       delay: str = "1 hour", exact: bool = True) -> DataFrame:
    """K4 end to end: block statistics of closed days."""
    return _run_to_table(spark, daily_stats(file_source(spark, folder, EVENT_SCHEMA, files), delay=delay, exact=exact),
                         "daily-stats")


def stream_assign(spark: SparkSession, folder: str, centers: DataFrame, vec: str = "embedding",
                  schema: T.StructType | None = None, files: str | None = None) -> DataFrame:
    """K5: assign streamed vectors to fixed centres (stateless, per micro-batch)."""
    from horosphere.operators.clustering import assign_nearest
    sch = schema or T.StructType([
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType())])
    src = file_source(spark, folder, sch, files)
    x = src.select("vec_id", F.transform(vec, lambda t: t.cast("double")).alias("v"))
    out = assign_nearest(x, centers, "v", out="pred")
    return _run_to_table(spark, out, "assign")


STAGED = "day"
_STATE = ("first timestamp_ntz, seen timestamp_ntz, m0_end timestamp_ntz, block long, upto date, late long, undated long, "
          "days array<struct<day:date,first:timestamp_ntz,last:timestamp_ntz,n:long,epochs:array<long>>>")


def _state(spark: SparkSession, workdir: str, epoch: int) -> dict:
    """What the batches up to ``epoch`` left: one row, no larger than the days in flight."""
    if epoch < 0:
        return {"first": None, "seen": None, "m0_end": None, "block": None, "upto": None, "late": 0, "undated": 0, "days": []}
    return spark.read.schema(_STATE).parquet(f"{workdir}/state/epoch={epoch}").first().asDict(True)


def stream_state(spark: SparkSession, workdir: str) -> DataFrame:
    """State after every batch of ``process_closed_blocks``: M0's end, last closed block and day, rows left out as
    late or undated so far, days in flight (column ``epoch`` from the path)."""
    return spark.read.schema(_STATE + ", epoch long").parquet(f"{workdir}/state")


def process_closed_blocks(stream: DataFrame, process_block: Callable[[DataFrame, int, str], DataFrame | None],
                          workdir: str, ts_col: str = "created_at", delay: str = "1 hour",
                          offline_days: int = 7):
    """K2/K3 driver: blocks M0 (the first ``offline_days`` days from the earliest
    message, not aligned to midnight), then one block per calendar date with data, each handed to
    ``process_block(rows, block_id, name)`` in order once its end has passed the watermark (largest
    event time seen minus ``delay``).

    State lives on shared storage under ``workdir``: every micro-batch's rows go
    to ``rows/epoch=<id>/day=<date>`` (overwritten when an epoch is replayed), and one row to ``state/epoch=<id>``: the
    state of the epoch before it carried on by this batch - M0's end, the last closed block, and for every day in flight its
    times, rows and the epochs that hold it. A batch reads that row and its own rows, and a closed block
    the folders of its own days, so the work does not grow with the age of the stream. What
    ``process_block`` returns, if anything, is written to ``metrics/block=<id>`` (a block repeated after a
    failure is the same block with the same rows: its result replaces the first one). Rows whose day (or
    M0's span) is closed when they arrive are late, rows without a time undated: both are left out and counted
    in the state. Returns the streaming query handle.
    """
    spark = stream.sparkSession
    wait = _interval(spark, delay)
    t = F.col(ts_col).cast("timestamp_ntz")

    def handler(batch: DataFrame, epoch: int) -> None:
        old = _state(spark, workdir, epoch - 1)
        batch.withColumn(STAGED, F.to_date(t)).write.mode("overwrite").partitionBy(STAGED).parquet(
            f"{workdir}/rows/epoch={epoch}")
        mine = spark.read.schema(batch.schema.add(STAGED, "date")).parquet(f"{workdir}/rows/epoch={epoch}")
        late = F.lit(False)
        if old["m0_end"] is not None:
            late = (F.col(STAGED) <= F.lit(old["upto"])) | (t < F.lit(old["m0_end"]))
        new = (mine.groupBy(STAGED, late.alias("late")).agg(F.min(t).alias("first"), F.max(t).alias("last"),
                                                            F.count(F.lit(1)).alias("n")).collect())  # rows per day
        days = {d["day"]: d for d in old["days"]}
        state = dict(old)
        for r in new:
            if r[STAGED] is None:
                state["undated"] += r["n"]
            elif r["late"]:
                state["late"] += r["n"]
                state["seen"] = max(x for x in (state["seen"], r["last"]) if x is not None)
            else:
                d = days.get(r[STAGED]) or {"day": r[STAGED], "first": r["first"], "last": r["last"], "n": 0, "epochs": []}
                days[r[STAGED]] = {"day": d["day"], "first": min(d["first"], r["first"]), "last": max(d["last"], r["last"]),
                                   "n": d["n"] + r["n"], "epochs": [*d["epochs"], epoch]}
                state["first"] = min(x for x in (state["first"], r["first"]) if x is not None)
                state["seen"] = max(x for x in (state["seen"], r["last"]) if x is not None)

        def finish(part: DataFrame, block: int) -> None:
            got = process_block(part, block, f"M{block}")
            if got is not None:
                got.write.mode("overwrite").parquet(f"{workdir}/metrics/block={block}")

        def staged(some: list) -> DataFrame:
            return spark.read.schema(batch.schema).parquet(
                *[f"{workdir}/rows/epoch={e}/{STAGED}={d['day']}" for d in some for e in d["epochs"]])

        if state["seen"] is not None:
            mark = state["seen"] - wait
            if state["m0_end"] is None and state["first"] + timedelta(days=offline_days) <= mark:
                end = state["m0_end"] = state["first"] + timedelta(days=offline_days)
                finish(staged([d for d in days.values() if d["first"] < end]).where(t < F.lit(end)), 0)
                state["block"], state["upto"] = 0, (end - timedelta(microseconds=1)).date() - timedelta(days=1)
                days = {k: d for k, d in days.items() if d["last"] >= end}
            if state["m0_end"] is not None:
                for day in sorted(days):
                    if datetime.combine(day, time()) + timedelta(days=1) > mark:
                        break
                    state["block"] += 1
                    finish(staged([days[day]]).where(t >= F.lit(state["m0_end"])), state["block"])
                    state["upto"] = day
                    del days[day]
        state["days"] = [days[k] for k in sorted(days)]
        spark.createDataFrame([tuple(state[f.name] for f in T._parse_datatype_string(_STATE).fields)], _STATE).coalesce(1) \
            .write.mode("overwrite").parquet(f"{workdir}/state/epoch={epoch}")

    return (stream.writeStream.option("checkpointLocation", f"{workdir}/ckpt")
            .foreachBatch(handler).trigger(availableNow=True).start())


def _interval(spark: SparkSession, text: str) -> timedelta:
    return spark.sql(f"SELECT CAST(INTERVAL {text} AS INTERVAL DAY TO SECOND)").first()[0]


def block_metrics(spark: SparkSession, workdir: str) -> DataFrame:
    """K3: the metrics of all finished blocks (column ``block`` from the path)."""
    return spark.read.parquet(f"{workdir}/metrics")


class IncrementalDetector:
    """K2/K3: the block step of an online run for ``process_closed_blocks``.

    Block ``b`` retrains the encoder iff ``b % window == 0`` (70/20 train and
    validation parts), every block is encoded, clustered with k = its distinct events and
    scored. Weights are stored per (run, block) under ``workdir/weights``; a block starts
    from the newest weights below its number, so a repeated block gives the same result.
    """

    def __init__(self, spark: SparkSession, workdir: str, cfg, run: int = 0):
        self.spark, self.workdir, self.cfg, self.run = spark, workdir, cfg, run

    def _path(self, block: int) -> str:
        return f"{self.workdir}/weights/run={self.run}/block={block}"

    def _weights(self, block: int, dim: int):
        from horosphere.operators.encoder import Encoder
        from horosphere.plans.experiments import encoder_config
        w = self.cfg.window
        newest = (block - 1) // w * w if block else -1    # the last retrained block below
        if newest < 0:
            return Encoder.init(encoder_config(self.cfg, dim), self.cfg.seed)
        return Encoder.load(self.spark, self._path(newest))

    def __call__(self, rows: DataFrame, block: int, name: str) -> DataFrame:
        from horosphere.operators import scores as S
        from horosphere.plans import experiments as X
        rows = rows.withColumn("block_id", F.lit(block).cast("long")).persist()
        enc = None
        if self.cfg.use_hyperbolic:
            enc = self._weights(block, len(rows.select("vec").first()["vec"]))
            if block % self.cfg.window == 0:
                X.train_block(enc, rows, self.cfg)
                enc.save(self.spark, self._path(block))
        pred = X.cluster_groups(X.embed(rows, enc), ["block_id"], self.cfg)
        score = S.evaluate_clustering(pred, "event", "pred", ["block_id"])
        stats = rows.agg(F.min("created_at").alias("start_ts"), F.max("created_at").alias("end_ts"),
                         F.count(F.lit(1)).alias("num_messages"), F.countDistinct("event").alias("num_events"))
        out = score.crossJoin(F.broadcast(stats)).withColumn("run", F.lit(self.run).cast("long")) \
            .withColumn("block_name", F.lit(name))
        out = cut_lineage(out)
        rows.unpersist()
        return out
