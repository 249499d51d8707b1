"""Row positions and neighbour windows that do not depend on group size.

A plain window partitioned by a key puts the whole key into one task. The helpers here
cut a long key into bounded pieces and still give the exact answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embedlab.session import join_summary, materialize

DEFAULT_BLOCK = 65_536


def dense_positions(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "pos"
) -> DataFrame:
    """Zero-based position of every row within ``group``, ordered by ``order``.

    Rows are range-partitioned on (group, order), so a hot group spans many partitions. The
    position is the place inside the sorted partition plus the number of rows of the same
    group in earlier partitions; only one row per (group, partition) is ever windowed.
    ``order`` must be unique within ``group``.
    """

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order]
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    marked = materialize(ranged.withColumn("_seq", F.monotonically_increasing_id()))
    marked = marked.withColumn("_part", F.shiftright("_seq", 33))
    runs = marked.groupBy(*group, "_part").agg(
        F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    earlier = (
        Window.partitionBy(*([F.col(g) for g in group] or [F.lit(0)]))
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    runs = runs.select(
        *group, "_part", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base")
    )
    placed = join_summary(marked, runs, [*group, "_part"])
    return placed.withColumn(name, F.col("_seq") - F.col("_first") + F.col("_base")).drop(
        "_seq", "_part", "_first", "_base"
    )


def boundary_key(df: DataFrame, column: str, place) -> tuple[object, int, int]:
    """``(key, n, total)``: the ``n``-th (one-based) distinct key in sort order, where
    ``place(total)`` gives ``n``. A null key is an error.

    The distinct keys are placed by range partitioning, once, and only the wanted one is fetched.
    """

    nothing = F.raise_error(F.lit(f"{column} has null keys")).cast("boolean")
    keys = df.select(column).distinct().filter(F.when(F.col(column).isNull(), nothing).otherwise(F.lit(True)))
    placed = materialize(dense_positions(keys, [], [column], "_p"))
    total = placed.count()
    n = place(total)
    found = placed.filter(F.col("_p") == n - 1).select(column).first()
    return (found[0] if found else None), n, total


def with_halo(
    df: DataFrame, position: str, left: int, block: int = DEFAULT_BLOCK
) -> DataFrame:
    """Assign rows to blocks of ``block`` positions (``left`` if that is more) and copy the last ``left`` rows of each
    block into the next one.

    ``_block`` is the block to window over and ``_own`` says whether the row belongs to it. A
    window over (key, ``_block``) sees everything a frame of ``left`` earlier rows needs.
    """

    block = max(block, left)
    home = F.floor(F.col(position) / block)
    spill = F.pmod(F.col(position), F.lit(block)) >= block - left
    blocks = F.when(spill, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn("_home", home).withColumn("_block", F.explode(blocks)).withColumn(
        "_own", F.col("_block") == F.col("_home")
    )


def over_left_context(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    left: int,
    columns: dict[str, "callable"],
    block: int = DEFAULT_BLOCK,
) -> DataFrame:
    """Evaluate window columns over the current row and ``left`` rows before it.

    ``columns`` maps a new name to a function from the ordered window to a column. ``position``
    counts rows without gaps within ``keys``.
    """

    window = Window.partitionBy(*keys, "_block").orderBy(position)
    out = with_halo(df, position, left, block)
    for name, build in columns.items():
        out = out.withColumn(name, build(window))
    return out.filter("_own").drop("_home", "_block", "_own")


def stable_order(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Global order for output; the columns must identify a row."""

    return df.orderBy(*columns)
