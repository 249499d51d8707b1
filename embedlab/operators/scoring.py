"""Apply maps to rows and score them on held-out pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedlab.operators.arrow import list_array, matrix, replace_column
from embedlab.operators.fits import FLOOR, LinearMap
from embedlab.operators.moments import MomentMatrices
from embedlab.session import materialize

COSINE_FLOOR = 1e-8
SKETCH_ACCURACY = 100_000


# ---------------------------------------------------------------- applying maps


def _schema_with(df: DataFrame, out: str) -> T.StructType:
    """The schema with a double array ``out`` added, or in place of the column it replaces."""

    target = T.StructField(out, T.ArrayType(T.DoubleType()))
    fields = [target if f.name == out else f for f in df.schema.fields]
    return T.StructType(fields if out in df.columns else [*fields, target])


def apply_map(df: DataFrame, mapping: LinearMap, x: str = "x", out: str = "x") -> DataFrame:
    """``x @ W + b`` by matrix products on Arrow batches; no shuffle."""

    weight, bias = mapping.weight, mapping.bias
    schema = _schema_with(df, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield replace_column(
                    batch, out, list_array(matrix(batch.column(x)) @ weight + bias)
                )

    return df.mapInArrow(run, schema)


def apply_maps(df: DataFrame, steps: Sequence[tuple[LinearMap, str, str]]) -> DataFrame:
    """Several ``(map, column, new column)`` in one Arrow pass."""

    schema = df.schema
    for _, _, out in steps:
        schema = T.StructType([*schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    plain = [(m.weight, m.bias, x, out) for m, x, out in steps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for weight, bias, x, out in plain:
                    moved = matrix(batch.column(x)) @ weight + bias
                    batch = replace_column(batch, out, list_array(moved))
                yield batch

    return df.mapInArrow(run, schema)


def projection_map(p: np.ndarray, pb: np.ndarray) -> LinearMap:
    """A projection stored as (out, in) in the row convention of maps."""

    return LinearMap("projection", np.asarray(p).T.copy(), np.asarray(pb))


def project(df: DataFrame, p: np.ndarray, pb: np.ndarray, x: str = "x", out: str = "x"):
    return apply_map(df, projection_map(p, pb), x, out)


def mlp_scores(
    df: DataFrame, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray,
    x: str = "x", out: str = "x",
) -> DataFrame:
    """Two-layer batch scoring, ``relu(x W1' + b1) W2' + b2``."""

    schema = _schema_with(df, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hidden = np.maximum(matrix(batch.column(x)) @ w1.T + b1, 0.0)
                yield replace_column(batch, out, list_array(hidden @ w2.T + b2))

    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- quantised projections


def half(values: np.ndarray) -> np.ndarray:
    return values.astype(np.float16).astype(np.float64)


def quantized(values: np.ndarray) -> np.ndarray:
    """8-bit blocks of 32 along the rows of a d x d matrix, and back."""

    if values.shape[-1] % 32:
        raise ValueError(f"a row of {values.shape[-1]} is not a multiple of 32")
    blocks = values.reshape(-1, 32)
    step = np.abs(blocks).max(axis=1, keepdims=True) / 127.0
    codes = np.clip(np.rint(blocks / np.maximum(step, 1e-30)), -128, 127)
    return (codes * half(step)).reshape(values.shape)


def deployed_map(mapping: LinearMap, p: np.ndarray, pb: np.ndarray) -> LinearMap:
    """The map as it will run: folded, weights quantised, bias left dense."""

    weight, bias = mapping.fold_into_projection(p, pb)
    return LinearMap(mapping.name, quantized(weight).T.copy(), bias, mapping.ord, mapping.alpha)


def lifted_map(mapping: LinearMap, target_width: int, projection=None) -> LinearMap:
    """Bring a map to the target's width, through the projection only if it has to."""

    if mapping.weight.shape[1] == target_width:
        return mapping
    if projection is None:
        raise ValueError(
            f"map {mapping.name} gives {mapping.weight.shape[1]} units, the target has "
            f"{target_width}, and there is no projection"
        )
    p, pb = projection
    if p.shape[0] != target_width or p.shape[1] != mapping.weight.shape[1]:
        raise ValueError(f"map {mapping.name} does not reach {target_width} units")
    return mapping.then(p.T, pb)


# ---------------------------------------------------------------- exact quantiles


def linear_quantile(
    df: DataFrame, by: Sequence[str], value: str, p: float, name: str = "q",
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """Exact quantile with linear interpolation per group.

    The built-in exact aggregate holds all distinct values of a group. Here a sketch of fixed size
    first brackets the two order statistics, and only the distinct values inside the bracket are
    sorted; the answer is exact as well. ``df`` is read twice: keep it first when it is costly.
    """

    by = list(by)
    slack = 3.0 / accuracy
    ends = [max(p - slack, 0.0), min(p + slack, 1.0)]
    # group keys are joined below, so give a keyless call one
    keys = by or ["_all"]
    source = df if by else df.withColumn("_all", F.lit(0))
    source = source.filter(F.col(value).isNotNull())
    sketch = source.groupBy(*keys).agg(
        F.percentile_approx(value, ends, accuracy).alias("_ends"),
        F.count(F.lit(1)).alias("_n"),
        F.min(value).alias("_least"),
        F.max(value).alias("_most"),
    )
    low = F.when(F.lit(ends[0] == 0.0), F.col("_least")).otherwise(F.col("_ends")[0])
    high = F.when(F.lit(ends[1] == 1.0), F.col("_most")).otherwise(F.col("_ends")[1])
    sketch = sketch.select(*keys, "_n", low.alias("_low"), high.alias("_high"))
    inside = source.select(*keys, F.col(value).alias("_v")).join(sketch, keys)
    # what lies below or above the bracket collapses to one counted row per group, with the value next
    # to the bracket: in a small group the order statistic may be one place outside
    band = F.when(F.col("_v") < F.col("_low"), -1).when(F.col("_v") > F.col("_high"), 1).otherwise(0)
    counted = (
        inside.groupBy(*keys, "_n", band.alias("_band"), F.when(band == 0, F.col("_v")).alias("_at"))
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_first"), F.max("_v").alias("_last"))
        .withColumn("_v", F.when(F.col("_band") < 0, F.col("_last")).otherwise(F.col("_first")))
    )
    running = Window.partitionBy(*keys).orderBy("_band", "_at")
    place = F.lit(p) * (F.col("_n") - 1)
    ranked = counted.withColumn("_upto", F.sum("_c").over(running))
    picked = ranked.groupBy(*keys).agg(
        F.min(F.when(F.col("_upto") > F.floor(place), F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_upto") > F.ceil(place), F.col("_v"))).alias("_b"),
        F.first(place - F.floor(place)).alias("_f"),
    )
    result = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")
    return picked.select(*by, result.alias(name))


# ---------------------------------------------------------------- scoring rows


ROW_SCHEMA = "ord int, j int, a double, b double, n bigint, cos double"


def score_parts(pairs: DataFrame, maps: Sequence[LinearMap], x: str = "x", y: str = "y"):
    """One pass over the rows for all maps.

    ``j = -1`` rows carry squared error and cosine of one pair under map ``ord``; rows with
    ``ord = -1`` carry, per partition and target unit ``j``, sum and sum of squares.
    """

    orders = np.array([m.ord for m in maps], dtype=np.int32)
    weights = [m.weight for m in maps]
    biases = [m.bias for m in maps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, squares = 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = matrix(batch.column(x)), matrix(batch.column(y))
            rows = len(left)
            sums = right.sum(axis=0) if sums is None else sums + right.sum(axis=0)
            square = np.square(right).sum(axis=0)
            squares = square if squares is None else squares + square
            count += rows
            length = np.maximum(np.linalg.norm(right, axis=1), COSINE_FLOOR)
            for order, weight, bias in zip(orders, weights, biases):
                guess = left @ weight + bias
                error = np.square(guess - right).sum(axis=1)
                own = np.maximum(np.linalg.norm(guess, axis=1), COSINE_FLOOR)
                cos = (guess * right).sum(axis=1) / (own * length)
                yield _score_batch(np.full(rows, order), np.full(rows, -1), error, None, None, cos)
        if sums is not None:
            units = len(sums)
            counts = np.zeros(units, dtype=np.int64)
            counts[0] = count
            yield _score_batch(
                np.full(units, -1), np.arange(units), sums, squares, counts, None
            )

    return pairs.select(x, y).mapInArrow(run, ROW_SCHEMA)


def _score_batch(order, unit, a, b, n, cos) -> pa.RecordBatch:
    size = len(a)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.asarray(order, dtype=np.int32)),
            pa.array(np.asarray(unit, dtype=np.int32)),
            pa.array(a),
            pa.array(b) if b is not None else pa.nulls(size, pa.float64()),
            pa.array(n) if n is not None else pa.nulls(size, pa.int64()),
            pa.array(cos) if cos is not None else pa.nulls(size, pa.float64()),
        ],
        names=["ord", "j", "a", "b", "n", "cos"],
    )


def _finish(sse: Column, spread: Column, energy: Column) -> tuple[Column, Column]:
    floor = F.lit(FLOOR)
    r2 = 1.0 - sse / F.greatest(spread, floor)
    return r2, F.sqrt(sse / F.greatest(energy, floor))


def score_rows(
    pairs: DataFrame,
    maps: Sequence[LinearMap],
    projection=None,
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """``(ord, map, alpha, r2, relative_error, cosine_mean, cosine_p05)`` per map.

    The spread is taken about the column means of the rows being scored.
    """

    if projection is not None:
        maps = [lifted_map(m, len(projection[1]), projection) for m in maps]
    # `ord` keys the score rows, so maps scored together need distinct ones
    if len({m.ord for m in maps}) != len(maps):
        raise ValueError("maps scored together must have distinct ord values")
    # two numbers per row and map, kept so that every product is made once
    parts = materialize(score_parts(pairs, maps, x, y))
    reduced = parts.groupBy("ord", "j").agg(
        F.sum("a").alias("a"),
        F.sum("b").alias("b"),
        F.sum("n").alias("n"),
        F.avg("cos").alias("cosine_mean"),
    )
    tail = linear_quantile(parts.filter("ord >= 0"), ["ord"], "cos", 0.05, "cosine_p05")
    reduced = reduced.join(tail, "ord", "left")
    # d + (number of maps) rows from here on
    whole = Window.partitionBy(F.lit(0))
    target = F.col("ord") < 0
    total = F.sum(F.when(target, F.col("n"))).over(whole)
    energy = F.sum(F.when(target, F.col("b"))).over(whole)
    means = F.sum(F.when(target, F.col("a") * F.col("a"))).over(whole) / total
    reduced = reduced.withColumn("_energy", energy).withColumn("_spread", energy - means)
    r2, relative = _finish(F.col("a"), F.col("_spread"), F.col("_energy"))
    names = F.create_map(*[v for m in maps for v in (F.lit(m.ord), F.lit(m.name))])
    alphas = F.create_map(
        *[v for m in maps for v in (F.lit(m.ord), F.lit(m.alpha).cast("double"))]
    )
    return reduced.filter("ord >= 0").select(
        "ord",
        names[F.col("ord")].alias("map"),
        alphas[F.col("ord")].alias("alpha"),
        r2.alias("r2"),
        relative.alias("relative_error"),
        "cosine_mean",
        "cosine_p05",
    )


def score_deployed(pairs: DataFrame, maps: Sequence[LinearMap], projection) -> DataFrame:
    """Scores of the folded, quantised maps against the projected target."""

    p, pb = projection
    return score_rows(pairs, [deployed_map(m, p, pb) for m in maps]).select(
        "ord",
        F.col("r2").alias("deployed_r2"),
        F.col("cosine_mean").alias("deployed_cosine_mean"),
    )


def score_from_moments(mapping: LinearMap, m: MomentMatrices) -> float:
    """R2 of a map from held-out moments alone; no row is read."""

    w, b = mapping.weight, mapping.bias
    syy = float(np.trace(m.syy))
    sse = (
        syy
        + float(np.einsum("ij,ik,kj->", w, m.sxx, w, optimize=True))
        + m.n * float(b @ b)
        - 2.0 * float((w * m.sxy).sum())
        + 2.0 * float(m.sx @ w @ b)
        - 2.0 * float(m.sy @ b)
    )
    spread = syy - float(m.sy @ m.sy) / m.n
    return 1.0 - sse / max(spread, FLOOR)


def projected_r2_from_moments(mapping: LinearMap, m: MomentMatrices, projection) -> float:
    """The same at projection width; needs moments with the full ``syy``.

    ``m`` pairs x with the unprojected target, and the target is projected too.
    """

    p, _ = projection
    w, b = mapping.weight, mapping.bias
    gram = p.T @ p
    # second moment of the error e = xW + b - y, then its projected length
    second = (
        w.T @ m.sxx @ w
        + m.n * np.outer(b, b)
        + m.syy
        - w.T @ m.sxy
        - (w.T @ m.sxy).T
        + np.outer(m.sx @ w, b)
        + np.outer(b, m.sx @ w)
        - np.outer(b, m.sy)
        - np.outer(m.sy, b)
    )
    spread = m.syy - np.outer(m.sy, m.sy) / m.n
    return 1.0 - float((second * gram).sum()) / max(float((spread * gram).sum()), FLOOR)


# ---------------------------------------------------------------- choosing


def best_map(ladder: DataFrame) -> DataFrame:
    """Highest deployed R2 (plain R2 without one) among shippable maps; first on ties."""

    criterion = F.coalesce(F.col("deployed_r2"), F.col("r2"))
    usable = ladder.filter(F.coalesce(F.col("shippable"), F.lit(True)))
    return (
        usable.withColumn("_c", criterion)
        .filter(~F.isnan("_c"))
        .orderBy(F.col("_c").desc(), "ord")
        .limit(1)
        .drop("_c")
    )


def flag_best_alpha(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``is_best`` (smallest alpha on ties) and ``at_edge`` to a penalty sweep.

    A sweep has one row per penalty and group, so the windows are tiny.
    """

    keys = [F.col(k) for k in by] or [F.lit(0)]
    criterion = F.coalesce(F.col("deployed_r2"), F.col("r2"))
    value = F.when(F.isnan(criterion), F.lit(None)).otherwise(criterion)
    ranked = Window.partitionBy(*keys).orderBy(value.desc_nulls_last(), "alpha")
    whole = Window.partitionBy(*keys)
    edge = (F.col("alpha") == F.min("alpha").over(whole)) | (
        F.col("alpha") == F.max("alpha").over(whole)
    )
    first = (F.row_number().over(ranked) == 1) & value.isNotNull()
    return sweep.withColumn("is_best", first).withColumn("at_edge", F.col("is_best") & edge)
