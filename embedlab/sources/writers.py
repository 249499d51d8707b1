"""Sinks for tensors, tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlab.functions.vectors import signed4


def write_tensors(tensors: DataFrame, path: str) -> None:
    """Partitioned by checkpoint, sorted by name so that readers skip row groups.

    Rows of one checkpoint are spread by name and row first: a large checkpoint becomes many
    files instead of one task.
    """

    (
        tensors.repartition("ckpt", "name", (F.col("row") / 4096).cast("bigint"))
        .sortWithinPartitions("ckpt", "name", "row")
        .write.partitionBy("ckpt")
        .parquet(path)
    )


def write_probe_table(table: DataFrame, path: str) -> None:
    table.write.json(path)


def build_report(header: DataFrame, ladder: DataFrame, transport: DataFrame | None = None) -> DataFrame:
    """One nested row: header columns, ladder array in ladder order, transport array.

    Ladder and transport have one row per map or group, so collecting them is bounded.
    """

    fields = [c for c in ladder.columns if c != "ord"]
    rows = ladder.agg(
        F.sort_array(F.collect_list(F.struct("ord", F.struct(*fields).alias("row")))).alias("_rows")
    ).select(F.transform("_rows", lambda r: r["row"]).alias("ladder"))
    out = header.withColumn("_k", F.lit(0)).join(rows.withColumn("_k", F.lit(0)), "_k")
    if transport is not None:
        matched = transport.agg(
            F.sort_array(F.collect_list(F.struct(*transport.columns))).alias("transport")
        )
        out = out.join(matched.withColumn("_k", F.lit(0)), "_k")
    return out.drop("_k")


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.json(path)


def report_lines(ladder: DataFrame) -> DataFrame:
    """One line per shippable map: name, R2 and cosine with sign and four decimals."""

    usable = ladder.filter(F.coalesce("shippable", F.lit(True)))
    line = F.concat(
        F.lit("| `"), F.col("map"), F.lit("` | "), signed4(F.col("r2")), F.lit(" | "),
        signed4(F.col("cosine_mean")), F.lit(" |"),
    )
    return usable.select("ord", line.alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.orderBy("ord").select("line").coalesce(1).write.text(path)
