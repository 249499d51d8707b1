"""Corpus selection: crops, seeded samples, group hold-out, batches and caps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedlab.functions.text import group_key
from embedlab.operators.ordering import boundary_key, dense_positions


def wanted_samples(seconds: float, rate: int) -> int:
    """Crop length in samples, rounding halves to even."""

    return int(round(seconds * rate))


def wanted_samples_col(seconds: Column, rate: Column) -> Column:
    return F.rint(seconds * rate).cast("bigint")


def duration(samples: Column, rate: int) -> Column:
    return samples / F.lit(float(rate))


def filter_min_length(recordings: DataFrame, want: int, length: str = "n_samples") -> DataFrame:
    return recordings.filter(F.col(length) >= want)


def crop_offset(length: Column, want: int, rate: int) -> Column:
    """Start a quarter of a second in, or as late as the crop still fits."""

    return F.least(length - want, F.lit(rate // 4).cast("bigint"))


def crop_array(samples: Column, offset: Column, count: Column | int) -> Column:
    count = F.lit(count) if isinstance(count, int) else count
    return F.slice(samples, (offset + 1).cast("int"), count.cast("int"))


def crop_text(text: Column, offset: Column, count: int) -> Column:
    return F.substring(text, (offset + 1).cast("int"), F.lit(count))


def require_rate(df: DataFrame, expected: int, rate: str = "rate", label: str = "path") -> DataFrame:
    """Fail the job on any row at another sample rate."""

    message = F.concat(
        F.col(label).cast("string"), F.lit(": "), F.col(rate).cast("string"), F.lit(" Hz")
    )
    checked = F.when(F.col(rate) == expected, F.col(rate)).otherwise(
        F.raise_error(message).cast("int")
    )
    return df.withColumn(rate, checked)


def quarantine_rate(df: DataFrame, expected: int, rate: str = "rate") -> DataFrame:
    """The tolerant variant: a ``status`` column instead of an error."""

    status = F.when(F.col(rate) == expected, F.lit("ok")).otherwise(
        F.concat(F.lit("rate "), F.col(rate).cast("string"))
    )
    return df.withColumn("status", status)


def downmix(samples: DataFrame, keys: Sequence[str] = ("clip", "t"), value: str = "v") -> DataFrame:
    """Average over channels."""

    return samples.groupBy(*keys).agg(F.avg(value).alias(value))


def require_nonempty(df: DataFrame, message: str) -> DataFrame:
    """Reads at most one row; raises before the expensive job starts."""

    if df.isEmpty():
        raise ValueError(message)
    return df


def sample_clips(
    recordings: DataFrame, want: int, rate: int, limit: int | None = None, seed: int = 0
) -> DataFrame:
    """Crops of recordings that are long enough, in seeded hash order.

    The order depends on path and seed only, never on file listing order. ``limit`` becomes a
    top-k per partition, not a sort of everything.
    """

    usable = filter_min_length(recordings, want)
    require_nonempty(usable, f"no recording reaches {want} samples")
    order = F.md5(F.concat(F.lit(str(seed)), F.col("path")))
    clips = usable.select(
        "path",
        crop_offset(F.col("n_samples"), want, rate).alias("offset"),
        F.lit(want).cast("bigint").alias("n_samples"),
        order.alias("_order"),
    )
    if limit is not None:
        clips = clips.orderBy("_order", "path").limit(limit)
    return clips.drop("_order")


def group_holdout(
    df: DataFrame, key: str, fraction: float = 0.2, message: str = "not enough groups to hold out"
) -> DataFrame:
    """Add ``split``: the first groups in sort order are ``eval``, the rest ``fit``.

    Only the boundary key travels (one row), so the rows are neither shuffled nor joined on
    the group key and a hot group costs nothing.
    """

    boundary, held, total = boundary_key(
        df, key, lambda count: max(1, int(round(count * fraction)))
    )
    if held >= total:
        raise ValueError(f"{message}: {held} of {total}")
    return df.withColumn(
        "split", F.when(F.col(key) <= F.lit(boundary), F.lit("eval")).otherwise(F.lit("fit"))
    )


def holdout_counts(df: DataFrame, key: str) -> DataFrame:
    """Groups and rows per split."""

    per_group = df.groupBy("split", key).agg(F.count(F.lit(1)).alias("_n"))
    return per_group.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("_n").alias("n_rows")
    )


def frame_count(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_frames"))


def with_group_key(recordings: DataFrame, path: str = "path") -> DataFrame:
    return recordings.withColumn("grp", group_key(F.col(path)))


def batches(
    df: DataFrame, size: int, order: Sequence[str], group: Sequence[str] = ()
) -> DataFrame:
    """Consecutive chunks of ``size`` rows; the last one may be short."""

    placed = dense_positions(df, group, order, "_pos")
    return placed.withColumn("batch_id", F.floor(F.col("_pos") / size)).drop("_pos")


def cap_rows(df: DataFrame, cap: int, order: Sequence[str]) -> DataFrame:
    """The first ``cap`` rows in order: a top-k, not a global sort."""

    return df.orderBy(*order).limit(cap)


def explode_frames(df: DataFrame, frames: str, keys: Sequence[str], name: str = "x") -> DataFrame:
    """One row per frame from a column holding an array of frames."""

    return df.select(*keys, F.posexplode(frames).alias("frame", name))


def explode_units(df: DataFrame, values: str, keys: Sequence[str]) -> DataFrame:
    """One row per (unit, feature): the transposed, long view of the frames."""

    return df.select(*keys, F.posexplode(values).alias("unit", "v"))
