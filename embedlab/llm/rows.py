"""Row keys, prepared documents and batch helpers shared by the text operators.

Documents are told apart by ``_key``, a 16-byte digest of id and text: rows with equal keys are
interchangeable, so null and repeated ids need no special case. Operators take only the columns
they use, and internal names start with an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embedlab.session import fresh_path, ship_package

NO_ID = (1 << 63) - 1
ROWS_PER_BATCH = 500


def prepare(spark: SparkSession) -> None:
    """Ship the package and keep Arrow batches small, as single texts may be very long."""

    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def row_key(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """Digest of id and text; a null text counts as empty, a null id differs from every number."""

    return F.unhex(
        F.md5(
            F.concat(
                F.coalesce(F.col(id_column).cast("string"), F.lit("")),
                F.lit("\x00"),
                F.coalesce(F.col(text_column), F.lit("")),
            ).cast("binary")
        )
    )


def keyed(docs: DataFrame) -> DataFrame:
    """``_key``, ``doc_id``, ``_rank`` (a null id ranks after all others) and the text as bytes."""

    return docs.select(
        row_key().alias("_key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_rank"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"),
    )


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not use yet, also ignoring case."""

    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut a batch where the values of ``column`` add up to about ``limit`` bytes."""

    values = batch.column(column)
    lengths = np.asarray(pc.binary_length(values), dtype=np.int64)
    group = (np.cumsum(lengths) - lengths) // limit
    edges = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(lengths)]))
    for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if end > start:
            part = batch.slice(start, end - start)
            yield part, part.column(column).to_pylist()


def record_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            values.cast(field.type) if isinstance(values, pa.Array) else pa.array(values, field.type)
            for field, values in ((f, columns[f.name]) for f in schema)
        ],
        schema=schema,
    )


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table below the shared folder and read it back: later steps start from the
    files, also after executors are lost. Compressed, unlike a checkpoint."""

    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
