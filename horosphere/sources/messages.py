"""Message sources (S1-S6): files, the driver's test tables, synthetic samples.

A message table always leaves here as
``msg_id BIGINT, text STRING, created_at TIMESTAMP_NTZ, event <STRING|BIGINT>``
plus whatever extra columns the input carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from horosphere.session import written

# The cell strings that pandas' read_csv turns into missing
# values by default (public pandas API). Kept so CSV input cleans the same way.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]


def _na_to_null(c: Column) -> Column:
    return F.when(c.isin(NA_TOKENS), F.lit(None)).otherwise(c)


def parse_time(c: Column, mode: str = "fail") -> Column:
    """String -> TIMESTAMP_NTZ. ``fail`` raises on a bad value, ``drop`` gives NULL.

    A trailing ``Z`` / offset is honoured by converting to UTC, whatever the
    session's time zone; a string without one is taken as it is.
    """
    s = F.trim(c)
    has_zone = s.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    if mode == "fail":
        zoned, plain = F.to_timestamp(s), s.cast("timestamp_ntz")
    elif mode == "drop":
        zoned, plain = F.try_to_timestamp(s), s.try_cast("timestamp_ntz")
    else:
        raise ValueError(f"unknown mode {mode!r}; use 'fail' or 'drop'")
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), zoned.cast("timestamp_ntz"))
    return F.when(has_zone, utc).otherwise(plain)


def standardize(df: DataFrame, text_col: str = "text", ts_col: str = "created_at",
                event_col: str = "event", id_col: str | None = None,
                mode: str = "fail", event_type: str | None = None,
                observation: Observation | None = None) -> DataFrame:
    """Required-column check, NA cleaning, time parse, null drop.

    Without ``id_col`` rows get numbers, which are written to the shared folder once.

    ``observation`` (optional) receives ``rows_in`` and ``rows_kept`` without
    a second scan; ``rows_in - rows_kept`` is the number of removed rows.
    """
    required = [text_col, ts_col, event_col]
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    out = df
    for c in (text_col, event_col):
        if dict(out.dtypes)[c] == "string":
            out = out.withColumn(c, _na_to_null(F.col(c)))
    tdt = dict(out.dtypes)[ts_col]
    if tdt == "string":
        out = out.withColumn(ts_col, parse_time(_na_to_null(F.col(ts_col)), mode))
    elif tdt == "timestamp":
        out = out.withColumn(ts_col, F.col(ts_col).cast("timestamp_ntz"))
    if event_type:
        out = out.withColumn(event_col, F.col(event_col).cast(event_type))
    if id_col is None:
        # numbered once and read back, so every later step sees the same ids
        out = written(out.withColumn("msg_id", F.monotonically_increasing_id()), "numbered-messages")
    elif id_col != "msg_id":
        out = out.withColumn("msg_id", F.col(id_col).cast("bigint"))
    if observation is not None:
        out = out.observe(observation, F.count(F.lit(1)).alias("rows_in"),
                          F.count_if(F.col(text_col).isNotNull() & F.col(ts_col).isNotNull()
                                     & F.col(event_col).isNotNull()).alias("rows_kept"))
    out = out.dropna(subset=required)
    rename = {text_col: "text", ts_col: "created_at", event_col: "event"}
    for old, new in rename.items():
        if old != new:
            out = out.withColumnRenamed(old, new)
    first = ["msg_id", "text", "created_at", "event"]
    return out.select(*first, *[c for c in out.columns if c not in first])


def read_messages(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False, **kw) -> DataFrame:
    """Read a message file (CSV with header, Parquet or JSON lines) and clean it.

    ``multi_line`` allows line ends inside quoted CSV cells; such a file cannot
    be split, so each is read by one task.
    """
    if fmt == "csv":
        raw = (spark.read.option("header", True).option("multiLine", multi_line)
               .option("escape", '"').option("inferSchema", False).csv(path))
    elif fmt == "parquet":
        raw = spark.read.parquet(path)
    elif fmt == "json":
        raw = spark.read.json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return standardize(raw, **kw)


def messages_from_tables(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    """The message table built from the driver's tables.

    ``events`` rows take the text of document ``event_id % count(documents)``;
    the event type is the true event. The document count is a one-row
    aggregate joined by broadcast (size fixed at one row).
    """
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n_docs = docs.select(F.count(F.lit(1)).alias("n_docs"))
    keyed = (ev.crossJoin(F.broadcast(n_docs))
             .withColumn("doc_id", F.col("event_id") % F.col("n_docs")))
    cols = ["doc_id", "text"] if with_text else ["doc_id"]
    # a null text removes its messages, whether or not the text is carried
    m = keyed.join(docs.where(F.col("text").isNotNull()).select(*cols), "doc_id")
    out = [F.col("event_id").alias("msg_id")]
    if with_text:
        out.append(F.col("text"))
    out += [F.col("ts").cast("timestamp_ntz").alias("created_at"),
            F.col("event_type").alias("event"), F.col("doc_id")]
    return m.select(*out).dropna(subset=(["text"] if with_text else []) + ["created_at", "event"])


def sample_messages(spark: SparkSession, n_messages: int = 1000, n_events: int = 50,
                    seed: int = 42, days: int = 30, start: str = "2024-01-01") -> DataFrame:
    """Synthetic messages. Whole hours in ``days`` days, random event.

    Hash-based draws, so every partitioning gives the same rows.
    """
    ids = spark.range(n_messages).withColumnRenamed("id", "msg_id")
    hour = F.pmod(F.xxhash64(F.col("msg_id"), F.lit(seed)), F.lit(24 * days))
    return ids.select(
        "msg_id",
        F.concat(F.lit("Sample message "), F.col("msg_id").cast("string"),
                 F.lit(" about event topic")).alias("text"),
        (F.to_timestamp_ntz(F.lit(f"{start} 00:00:00"))
         + F.make_dt_interval(hours=hour.cast("int"))).alias("created_at"),
        F.pmod(F.xxhash64(F.col("msg_id"), F.lit(seed + 1)), F.lit(n_events)).alias("event"),
    )


def write_messages_csv(df: DataFrame, path: str) -> None:
    """Sink for S6: CSV with header, sorted by time (sort only here, at the sink)."""
    (df.orderBy("created_at", "msg_id").select("text", "created_at", "event")
     .write.mode("overwrite").option("header", True).option("escape", '"').csv(path))
