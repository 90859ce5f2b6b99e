"""Session construction and cluster-safe helpers.

Nothing here assumes local mode: the checkpoint folder is read from the
session (``spark.checkpoint.dir``) and only chosen by us when the session
has none *and* runs in local mode (tests, bench).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "horosphere", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators rely on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    }
    if (master or "").startswith("local"):
        conf["spark.driver.memory"] = os.environ.get("HOROSPHERE_DRIVER_MEMORY", "8g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    # Settings that must hold even when the session already existed.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``horosphere`` importable on executors (once per SparkContext).

    Python functions run by ``mapInPandas`` are pickled by reference to their
    module, so workers must import the package: it is zipped on the driver
    and distributed with ``addPyFile``.
    """
    import shutil

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = tempfile.mkdtemp(prefix="horosphere-pkg-")
    archive = shutil.make_archive(os.path.join(base, "horosphere"), "zip",
                                  root_dir=os.path.dirname(pkg), base_dir="horosphere")
    sc.addPyFile(archive)
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Uses ``spark.checkpoint.dir`` when the cluster names one. Only a local
    session without that setting gets a fresh folder under /tmp.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return sc.getCheckpointDir() or d
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; name a shared folder for the cluster")
    d = tempfile.mkdtemp(prefix="horosphere-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: results of user callables are paid
    for once, and a lost executor takes nothing with it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collect_bounded(df: DataFrame, max_rows: int, what: str) -> list:
    """Collect a table whose size is bounded by a parameter (centres, weights).

    Fetches at most ``max_rows + 1`` rows and fails loudly when the bound is
    broken, so nothing unbounded ever reaches the driver.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows; refusing to collect")
    return rows
