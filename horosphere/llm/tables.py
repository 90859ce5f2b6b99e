"""Small helpers shared by the operators: shared-folder tables and plain text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horosphere.session import scratch_path, ship_package


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cut lineage that
    outlives any executor, and a plan the next step can read twice."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Make the package importable on executors and bound what a Python task holds
    at once: whole texts can be long, so their batches have few rows."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col, n: int):
    """crc32(doc_id as text) mod n; null where the id is null."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


def fold(doc_id: str, n: int, k: int):
    """True where crc32(doc_id as text) mod n = k; false for a null id."""
    return F.coalesce(crc_mod(doc_id, n) == k, F.lit(False))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's vocabulary file (the same on every machine)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def split_pattern() -> str:
    """The pattern that cuts texts before the merges of the rank files."""
    import public_tokenizers
    return public_tokenizers.PATTERN
