"""Session defaults and the one place that cuts lineage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


BROADCAST_BYTES = 128 << 20


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench."""

    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("embedlab")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Not needed when it is installed on the cluster or passed with ``--py-files``.
    """

    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="embedlab-py-")) / "embedlab"
    zipped = shutil.make_archive(str(archive), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(zipped)
    _shipped.add(application)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session without the setting falls back to a temporary folder; on a
    cluster a machine-local folder would be lost with its executor.
    """

    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="embedlab-"))
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; nothing is ever overwritten there."""

    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and freezes row placement."""

    spark = df.sparkSession
    root = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def kept_summary(summary: DataFrame, row_bytes: int = 64) -> DataFrame:
    """Per-key statistics, computed once and kept, marked for broadcast only if their counted
    size is below ``BROADCAST_BYTES``."""

    kept = materialize(summary)
    return F.broadcast(kept) if kept.count() * row_bytes <= BROADCAST_BYTES else kept


def join_summary(
    rows: DataFrame, summary: DataFrame, keys: Sequence[str], row_bytes: int = 64
) -> DataFrame:
    """Join rows with per-key statistics, without shuffling the rows when that is safe.

    Too large a summary goes through a shuffle join, where adaptive execution splits hot keys.
    """

    return rows.join(kept_summary(summary, row_bytes), list(keys))
