"""Additive statistics over a stream of pairs.

Sums commute, so there is no watermark: the state is at most 3*d*d cells per group and
order of arrival does not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from embedlab.operators.matching import rms_normalize
from embedlab.operators.moments import merge_moments, moments, partial_moments, sum_cells


def read_pair_stream(
    spark: SparkSession, path: str, schema, files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_moments(stream: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Streaming form of the moments: state lives in the state store, one row per cell.

    Each micro-batch is reduced on Arrow batches before it reaches the state.
    """

    return sum_cells(partial_moments(stream, by), by)


def write_partial_moments(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    by: Sequence[str] = (),
    rms_keys: Sequence[str] | None = None,
    **options,
) -> StreamingQuery:
    """Restart-safe form: each micro-batch writes its own moments under its batch id.

    Replaying a batch after a failure overwrites exactly its own partial, so nothing is
    counted twice. With ``rms_keys`` the rows are scaled per (batch, hook) first.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if rms_keys is None else rms_normalize(batch, rms_keys)
        moments(rows, by, **options).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def merged_partials(spark: SparkSession, out: str, by: Sequence[str] = ()) -> DataFrame:
    return merge_moments(spark.read.parquet(out).drop("batch_id"), by=by)


def write_capped(stream: DataFrame, out: str, checkpoint: str, cap: int) -> int:
    """Keep micro-batches until ``cap`` rows are there, then stop reading the stream.

    What earlier runs wrote is counted once at the start; then each micro-batch adds its own count, and
    a batch that is replayed replaces its earlier one. Returns the rows written; :func:`capped_rows`
    cuts them to exactly ``cap``.
    """

    spark = stream.sparkSession
    batches = _rows_below(spark, out)
    kept = {"rows": sum(batches.values())}

    def write(batch: DataFrame, batch_id: int) -> None:
        if kept["rows"] >= cap:
            return
        part = f"{out}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(part)
        batches[batch_id] = spark.read.schema(batch.schema).parquet(part).count()
        kept["rows"] = sum(batches.values())

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    while not query.awaitTermination(1):
        if kept["rows"] >= cap:
            query.stop()
    return kept["rows"]


def _rows_below(spark: SparkSession, out: str) -> dict[int, int]:
    """Rows per micro-batch already written; a folder that is not there yet has none."""

    folder = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return {}
    counts = spark.read.parquet(out).groupBy("batch_id").count().collect()
    return {row["batch_id"]: row["count"] for row in counts}


def capped_rows(spark: SparkSession, out: str, cap: int, order: Sequence[str]) -> DataFrame:
    """Earlier micro-batches first, then ``order``; exactly ``cap`` rows if there are enough."""

    rows = spark.read.parquet(out)
    return rows.orderBy(F.col("batch_id"), *order).limit(cap).drop("batch_id")
