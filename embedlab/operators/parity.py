"""Compare embedding sets with each other or with what a log says about them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedlab.functions.text import numbers
from embedlab.operators.pairing import guarded_join

# Tolerance in standard deviations, edge length and scale floor.
TOLERANCE = 0.05
EDGE = 16
SCALE_FLOOR = 1e-9
NUMBER = r"([-+\d.eE]+)"


def parse_debug_block(
    logs: DataFrame, begin: str = "=== BEGIN ===", end: str = "=== END ===", text: str = "text"
) -> DataFrame:
    """Add ``block``: shape, first and last values, statistics. Null without a block.

    A block that is there but incomplete fails the job.
    """

    def literal(s: str) -> str:
        return "".join(c if c.isalnum() or c == " " else "\\" + c for c in s)

    pattern = f"(?s){literal(begin)}(.*?){literal(end)}"
    body = F.regexp_extract(F.col(text), pattern, 1)
    found = F.regexp_like(F.col(text), F.lit(pattern))
    shape = r"Shape:\s*\[(\d+),\s*(\d+)\]"
    first = r"first 16 values\):\s*([-+\d.eE\s]+)"
    last = r"last 16 values\):\s*([-+\d.eE\s]+)"
    stats = rf"Stats:\s*mean={NUMBER},\s*std={NUMBER},\s*min={NUMBER},\s*max={NUMBER}"
    pick = lambda p, g: F.regexp_extract("_body", p, g)
    whole = F.lit(True)
    for part in (shape, first, last, stats):
        whole = whole & F.regexp_like("_body", F.lit(part))
    number = lambda s: F.regexp_replace(s, r"[,.]+$", "").cast("double")
    block = F.struct(
        pick(shape, 1).cast("bigint").alias("width"),
        pick(shape, 2).cast("bigint").alias("frames"),
        numbers(pick(first, 1)).alias("first"),
        numbers(pick(last, 1)).alias("last"),
        number(pick(stats, 1)).alias("mean"),
        number(pick(stats, 2)).alias("std"),
        number(pick(stats, 3)).alias("min"),
        number(pick(stats, 4)).alias("max"),
    )
    marked = logs.withColumn("_body", F.when(found, body))
    parsed = F.when(F.col("_body").isNull(), F.lit(None)).when(whole, block).otherwise(
        F.raise_error(F.lit("a debug block is there but does not parse")).cast(
            "struct<width:bigint,frames:bigint,first:array<double>,last:array<double>,"
            "mean:double,std:double,min:double,max:double>"
        )
    )
    return marked.withColumn("block", parsed).drop("_body")


def describe_block(
    frames: DataFrame, by: Sequence[str], frame: str, values: str = "x"
) -> DataFrame:
    """Statistics over all cells and the two ends of the first frame, per group.

    Cells are reduced inside each row first, so nothing is exploded. The deviation is the
    spread inside rows plus the spread of the row means, which does not cancel.
    """

    v = F.col(values)
    size = F.size(v).cast("double")
    fold = lambda f: F.aggregate(v, F.lit(0.0), f)
    rows = frames.select(*by, F.col(frame).alias("_frame"), v.alias(values), size.alias("_n"))
    # only the ends of a row travel with the aggregate, not the whole vector
    edge = F.least(F.size(v), F.lit(EDGE))
    ends = F.struct(F.slice(v, F.lit(1), edge).alias("first"), F.slice(v, -edge, edge).alias("last"))
    rows = rows.withColumn("_ends", ends)
    rows = rows.withColumn("_s", fold(lambda a, x: a + x))
    rows = rows.withColumn("_m", F.col("_s") / F.col("_n"))
    rows = rows.withColumn("_lo", F.array_min(v)).withColumn("_hi", F.array_max(v))
    rows = rows.withColumn(
        "_within", fold(lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m")))
    )
    reduced = rows.groupBy(*by).agg(
        F.min_by("_ends", "_frame").alias("_first_row"),
        F.count(F.lit(1)).alias("frames"),
        F.max("_n").cast("bigint").alias("width"),
        F.sum("_n").alias("_cells"),
        F.sum("_s").alias("sum"),
        F.sum("_within").alias("_within"),
        F.var_pop("_m").alias("_between"),
        F.min("_lo").alias("min"),
        F.max("_hi").alias("max"),
    )
    return reduced.select(
        *by, "width", "frames",
        F.col("_first_row.first"),
        F.col("_first_row.last"),
        (F.col("sum") / F.col("_cells")).alias("mean"),
        F.sqrt(F.col("_within") / F.col("_cells") + F.col("_between")).alias("std"),
        "min", "max", "sum",
    )


def format_block(described: DataFrame, begin: str = "=== BEGIN ===", end: str = "=== END ===") -> Column:
    """The log text of a description, six decimals."""

    listed = lambda c: F.array_join(
        F.transform(c, lambda x: F.format_string("%.6f", x)), " "
    )
    return F.concat(
        F.lit(begin + "\nShape: ["), F.col("width").cast("string"), F.lit(", "),
        F.col("frames").cast("string"), F.lit("]\nToken 0 (first 16 values): "), listed("first"),
        F.lit("\nToken 0 (last 16 values): "), listed("last"),
        F.format_string(
            "\nStats: mean=%.6f, std=%.6f, min=%.6f, max=%.6f\n", "mean", "std", "min", "max"
        ),
        F.lit(end + "\n"),
    )


def parity(mine: DataFrame, theirs: DataFrame, by: Sequence[str], tolerance: float = TOLERANCE) -> DataFrame:
    """``(by..., check, delta, ok)``: differences in units of our standard deviation.

    ``theirs`` has a ``block`` struct; the checks of a group all pass or the group fails. A group
    without a log, or whose log has no block, fails every check and has no deltas.
    """

    joined = mine.join(theirs.select(*by, "block"), list(by), "left")
    b = lambda f: F.col(f"block.{f}")
    scale = F.greatest(F.col("std"), F.lit(SCALE_FLOOR))
    worst = lambda own, other: F.array_max(
        F.zip_with(own, other, lambda p, q: F.abs(p - q))
    ) / scale
    same_shape = (F.col("width") == b("width")) & (F.col("frames") == b("frames"))
    rows = [
        F.struct(F.lit(name).alias("check"), F.lit(0.0).alias("delta"), F.coalesce(ok, F.lit(False)).alias("ok"))
        for name, ok in (("block", F.col("block").isNotNull()), ("shape", same_shape))
    ]
    deltas = {
        "first": worst(F.col("first"), b("first")),
        "last": worst(F.col("last"), b("last")),
        **{k: F.abs(F.col(k) - b(k)) / scale for k in ("mean", "std", "min", "max")},
    }
    rows += [
        F.struct(F.lit(k).alias("check"), d.alias("delta"), F.coalesce(d < tolerance, F.lit(False)).alias("ok"))
        for k, d in deltas.items()
    ]
    return joined.select(*by, F.inline(F.array(*rows)))


def parity_verdict(checks: DataFrame, by: Sequence[str]) -> DataFrame:
    return checks.groupBy(*by).agg(
        F.bool_and("ok").alias("ok"), F.max("delta").alias("worst_delta")
    )


def vector_diff(
    a: DataFrame, b: DataFrame, key: Sequence[str], values: str = "v", by: Sequence[str] = ()
) -> DataFrame:
    """Mean and largest absolute error, and the cosine of the two sets taken as one vector."""

    joined = guarded_join({"_x": (a, values), "_y": (b, values)}, key, carry=by)
    fold = lambda f: F.aggregate(
        F.zip_with("_x", "_y", f), F.lit(0.0), lambda s, v: s + v
    )
    rows = joined.select(
        *by,
        F.size("_x").alias("_n"),
        fold(lambda x, y: F.abs(x - y)).alias("_abs"),
        F.array_max(F.zip_with("_x", "_y", lambda x, y: F.abs(x - y))).alias("_max"),
        fold(lambda x, y: x * y).alias("_xy"),
        fold(lambda x, y: x * x).alias("_xx"),
        fold(lambda x, y: y * y).alias("_yy"),
    )
    return rows.groupBy(*by).agg(
        (F.sum("_abs") / F.sum("_n")).alias("mae"),
        F.max("_max").alias("max_error"),
        (F.sum("_xy") / F.sqrt(F.sum("_xx") * F.sum("_yy"))).alias("cosine"),
    )
