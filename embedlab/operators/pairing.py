"""Joins that build pairs, and set operations on keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_frames(
    source: DataFrame, target: DataFrame, on: Sequence[str], x: str = "x", y: str = "y"
) -> DataFrame:
    """Equi-join on the frame key; a frame without its partner fails the job.

    The guard rides on the one full outer join: no second pass counts frames.
    """

    on = list(on)
    left = source.select(*on, x, F.lit(True).alias("_l"))
    right = target.select(*on, y, F.lit(True).alias("_r"))
    both = left.join(right, on, "full_outer")
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in on])
    lonely = F.col("_l").isNull() | F.col("_r").isNull()
    # a filter, so that the check cannot be pruned with an unused column
    guard = F.when(lonely, F.raise_error(F.concat(F.lit("frame on one side only: "), key)).cast("boolean"))
    return both.filter(guard.otherwise(F.lit(True))).select(*on, x, y)


def guarded_join(
    tables: dict[str, tuple[DataFrame, str]], on: Sequence[str], carry: Sequence[str] = ()
) -> DataFrame:
    """Equi-join of two or more tables of arrays that must have the same keys and widths.

    ``tables`` maps the name of each result column to (table, column); ``carry`` are further columns of
    the first table. A key missing from a table, or arrays of different sizes, fail the job. The guard
    rides on the one full outer join: no second pass compares keys.
    """

    on = list(on)
    joined = None
    for place, (name, (table, column)) in enumerate(tables.items()):
        extra = [c for c in carry if c not in on] if place == 0 else []
        part = table.select(*on, *extra, F.col(column).alias(name), F.lit(True).alias(f"_in_{name}"))
        joined = part if joined is None else joined.join(part, on, "full_outer")
    names = list(tables)
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in on])
    absent = F.concat_ws(",", *[F.when(F.col(f"_in_{n}").isNull(), F.lit(n)) for n in names])
    missing = F.raise_error(F.concat(F.lit("missing from "), absent, F.lit(": "), key)).cast("boolean")
    uneven = F.raise_error(F.concat(F.lit("widths differ: "), key)).cast("boolean")
    size = F.size(names[0])
    same = F.lit(True)
    for name in names[1:]:
        same = same & size.eqNullSafe(F.size(name))
    guard = F.when(absent != "", missing).when(~same, uneven).otherwise(F.lit(True))
    return joined.filter(guard).select(*on, *[c for c in carry if c not in on], *names)


def unpaired_counts(source: DataFrame, target: DataFrame, clip: str) -> DataFrame:
    """Clips whose two frame counts differ."""

    a = source.groupBy(clip).agg(F.count(F.lit(1)).alias("n_source"))
    b = target.groupBy(clip).agg(F.count(F.lit(1)).alias("n_target"))
    both = a.join(b, clip, "full_outer").na.fill(0, ["n_source", "n_target"])
    return both.filter(F.col("n_source") != F.col("n_target"))


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def first_last_take(takes: DataFrame, by: Sequence[str] = ("lang", "sentence_id")) -> DataFrame:
    """First and last take per sentence in file order; the same one when there is one."""

    return takes.groupBy(*by).agg(
        F.min_by("path", "ord").alias("first_take"),
        F.max_by("path", "ord").alias("last_take"),
        F.count(F.lit(1)).alias("n_takes"),
    )


def existing_only(manifest: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    return manifest.join(files.select(key), key, "left_semi")


def key_difference(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys missing from at least one table, with ``missing_from``.

    Each table is reduced to its distinct keys before the one shuffle on the key.
    """

    labelled = None
    for label, table in tables.items():
        part = table.select(F.col(key), F.lit(label).alias("_from")).distinct()
        labelled = part if labelled is None else labelled.unionByName(part)
    labels = F.array(*[F.lit(label) for label in tables])
    found = labelled.groupBy(key).agg(F.collect_set("_from").alias("_found"))
    missing = F.array_sort(F.array_except(labels, F.col("_found")))
    return found.select(key, F.array_join(missing, ",").alias("missing_from")).filter(
        "missing_from <> ''"
    )


def require_same_keys(tables: dict[str, DataFrame], key: str) -> None:
    """Raise with the count and four sorted examples when the key sets differ."""

    difference = key_difference(tables, key)
    total = difference.count()
    if total:
        examples = [r[0] for r in difference.orderBy(key).limit(4).collect()]
        raise ValueError(f"{total} tensors are not in all tables, e.g. {examples}")


def hook_group(key: Column) -> Column:
    """All residual hook points share one group; every other key is its own."""

    return F.when(key.startswith("residual"), F.lit("residual")).otherwise(key)


def match_hook_points(source: DataFrame, target: DataFrame, on: Sequence[str]) -> DataFrame:
    """Join two activation tables on hook key and frame, then collapse residual keys.

    A source row without a target fails the job; targets nobody asked for are left out.
    """

    value = next(c for c in target.columns if c not in on)
    joined = left_driven_join(source, target, on, value).withColumnRenamed("_right", value)
    return joined.withColumn("grp", hook_group(F.col(on[0])))


# The kinds a caller may ask for.
GROUP_KINDS = ("residual", "ffn", "conv", "head")


def wanted_kinds(spec: str) -> set[str]:
    """``all``, ``none`` or a comma list; unknown kinds raise and list the choices."""

    if spec in ("", "none"):
        return set()
    if spec == "all":
        return set(GROUP_KINDS)
    asked = {part.strip() for part in spec.split(",")} - {""}
    unknown = sorted(asked.difference(GROUP_KINDS))
    if unknown:
        raise ValueError(f"unknown group kinds {unknown}; choose from {', '.join(GROUP_KINDS)}, all, none")
    return asked


def select_groups(df: DataFrame, spec: str, kind: str = "kind") -> DataFrame:
    """A filter on a plain column, so it reaches the scan."""

    return df.filter(F.col(kind).isin(sorted(wanted_kinds(spec))))


def left_driven_join(left: DataFrame, right: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Keys of ``left`` decide; a key missing on the right is an error, extra ones are dropped."""

    on = list(on)
    b = right.select(*on, F.col(value).alias("_right"))
    joined = left.join(b, on, "left")
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in on])
    present = F.when(F.col("_right").isNotNull(), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("missing on the right: "), key)).cast("boolean")
    )
    return joined.filter(present)


def band_join(
    queries: DataFrame, keys: DataFrame, by: str, position: str, left: int
) -> DataFrame:
    """Pairs with ``0 <= q - k <= left`` inside a sequence.

    Positions are bucketed by ``left + 1``: a query meets keys of its own bucket and the one
    before, so this is an equi-join whose groups hold at most ``2 * (left + 1)`` keys however
    long the sequence is.
    """

    width = left + 1
    q = queries.withColumnRenamed(position, "q").withColumn("_bucket", F.floor(F.col("q") / width))
    k = keys.withColumnRenamed(position, "k")
    home = F.floor(F.col("k") / width)
    k = k.withColumn("_bucket", F.explode(F.array(home, home + 1)))
    gap = F.col("q") - F.col("k")
    return q.join(k, [by, "_bucket"]).filter((gap >= 0) & (gap <= left)).drop("_bucket")


def band_counts(frames: DataFrame, by: str, position: str, left: int) -> DataFrame:
    """Number of keys each query may look at, without producing the pairs."""

    from embedlab.operators.ordering import over_left_context

    counted = over_left_context(
        frames.select(by, position), [by], position, left,
        {"n_keys": lambda w: F.count(F.lit(1)).over(w.rowsBetween(-left, Window.currentRow))},
    )
    return counted.withColumnRenamed(position, "q")
