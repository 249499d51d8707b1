"""Unit matching: costs from moments, transport plans, and operators on sparse plans.

A plan is ``(group, src, tgt, mass)`` with only the non-zero cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedlab.functions import vectors as V
from embedlab.operators.arrow import list_array, matrix
from embedlab.operators.moments import PARTIAL_FIELDS, MomentMatrices, PartialSums, sum_cells
from embedlab.session import join_summary

FLOOR = 1e-12
METRICS = ("cosine", "correlation")


def rms_normalize(
    pairs: DataFrame, keys: Sequence[str], columns: Sequence[str] = ("x", "y"), width: int | None = None
) -> DataFrame:
    """Divide each batch of a hook point by its root mean square."""

    keys = list(keys)
    energy = pairs.groupBy(*keys).agg(
        *[
            F.sqrt(
                F.sum(V.squared_norm(F.col(c), width)) / F.sum(F.size(F.col(c)).cast("double"))
            ).alias(f"_rms_{c}")
            for c in columns
        ]
    )
    out = join_summary(pairs, energy, keys)
    for c in columns:
        scale = F.greatest(F.col(f"_rms_{c}"), F.lit(FLOOR))
        out = out.withColumn(c, V.divide(F.col(c), scale))
    return out.drop(*[f"_rms_{c}" for c in columns])


def _centering(metric: str) -> float:
    """1 where sums of products are taken about the means, 0 where they are taken as they are."""

    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; choose from {', '.join(METRICS)}")
    return float(metric == "correlation")


def unit_distances(m: MomentMatrices, metric: str) -> np.ndarray:
    """The matrix behind ``unit_cost``, for moments that are on the driver already."""

    about = _centering(metric) / m.n
    x_scale = 1.0 / np.sqrt(np.maximum(np.diag(m.sxx) - about * m.sx**2, FLOOR))
    y_scale = 1.0 / np.sqrt(np.maximum(np.diag(m.syy) - about * m.sy**2, FLOOR))
    return 1.0 - x_scale[:, None] * (m.sxy - about * m.sx[:, None] * m.sy) * y_scale


def _grid(values: np.ndarray, name: str, keep: np.ndarray | None = None) -> pd.DataFrame:
    src, tgt = np.nonzero(np.ones_like(values) if keep is None else keep)
    return pd.DataFrame(
        {"src": src.astype(np.int32), "tgt": tgt.astype(np.int32), name: values[src, tgt]}
    )


def unit_cost(moment_rows: DataFrame, metric: str = "correlation", by: Sequence[str] = ()) -> DataFrame:
    """``(by..., src, tgt, cost)``; smaller means the two units behave alike.

    Equi-joins of moment rows: the products of each pair of units meet the sums of the two units, so
    no group is held in one task. ``moment_rows`` is read four times; keep it first when it is costly.
    """

    about = F.lit(_centering(metric))
    keys = list(by) or ["_all"]
    cells = moment_rows if by else moment_rows.withColumn("_all", F.lit(0))

    def units(first: str, second: str, unit: str, total: str, length: str) -> DataFrame:
        """Per unit its sum and, about the mean or not, its length."""

        own = cells.filter(F.col("kind").isin("n", first, second) & ((F.col("kind") != second) | (F.col("i") == F.col("j"))))
        counts = own.filter("kind = 'n'").select(*keys, F.col("v").alias("_n"))
        sums = own.filter("kind <> 'n'").groupBy(*keys, F.col("i").alias(unit)).agg(
            F.sum(F.when(F.col("kind") == first, F.col("v"))).alias(total),
            F.sum(F.when(F.col("kind") == second, F.col("v"))).alias("_square"),
        )
        spread = F.col("_square") - about * F.col(total) * F.col(total) / F.col("_n")
        return sums.join(counts, keys).select(
            *keys, unit, total, F.sqrt(F.greatest(spread, F.lit(FLOOR))).alias(length), F.col("_n").alias(f"_n_{unit}")
        )

    sources = units("sx", "sxx", "src", "_sx", "_lx")
    targets = units("sy", "syy", "tgt", "_sy", "_ly").drop("_n_tgt")
    crossed = cells.filter("kind = 'sxy'").select(
        *keys, F.col("i").alias("src"), F.col("j").alias("tgt"), F.col("v").alias("_sxy")
    )
    together = F.col("_sxy") - about * F.col("_sx") * F.col("_sy") / F.col("_n_src")
    joined = crossed.join(sources, [*keys, "src"]).join(targets, [*keys, "tgt"])
    return joined.select(
        *by, "src", "tgt", (1.0 - together / (F.col("_lx") * F.col("_ly"))).alias("cost")
    )


# ---------------------------------------------------------------- solving one d x d problem


def transport(cost: np.ndarray, supply: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """Integer amounts moved at least cost; all of ``supply`` is placed.

    Successive shortest paths with potentials over the dense cost matrix. ``demand`` may
    exceed ``supply``; with unit amounts this is the assignment problem.
    """

    rows, columns = cost.shape
    left, room = supply.astype(np.int64).copy(), demand.astype(np.int64).copy()
    if left.sum() > room.sum():
        raise ValueError("more supply than demand")
    flow = np.zeros((rows, columns), dtype=np.int64)
    u, v = cost.min(axis=1), np.zeros(columns)
    for start in range(rows):
        while left[start] > 0:
            # shortest reduced-cost path from `start` to a column with room
            near = np.full(columns, np.inf)
            from_row = np.full(columns, -1, dtype=np.int64)
            into_row = {start: -1}
            done = np.zeros(columns, dtype=bool)
            reached = {start: 0.0}
            frontier = [start]
            while True:
                for row in frontier:
                    step = reached[row] + cost[row] - u[row] - v
                    better = ~done & (step < near)
                    near[better] = step[better]
                    from_row[better] = row
                candidates = np.where(done, np.inf, near)
                column = int(np.argmin(candidates))
                distance = candidates[column]
                done[column] = True
                if room[column] > 0:
                    break
                frontier = [int(r) for r in np.nonzero(flow[:, column])[0] if r not in reached]
                for row in frontier:
                    reached[row] = distance
                    into_row[row] = column
            for row, at in reached.items():
                u[row] += distance - at
            v[done] -= distance - near[done]
            # walk back to find how much fits, then move it
            path, at = [], column
            while at != -1:
                row = int(from_row[at])
                path.append((row, at))
                at = into_row[row]
            amount = min(left[start], room[column])
            for row, _ in path[:-1]:
                amount = min(amount, flow[row, into_row[row]])
            for position, (row, at) in enumerate(path):
                flow[row, at] += amount
                if position < len(path) - 1:
                    flow[row, into_row[row]] -= amount
            left[start] -= amount
            room[column] -= amount
    return flow


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-cost matching of the smaller side; returns row and column indices."""

    rows, columns = cost.shape
    if rows > columns:
        tgt, src = assign(cost.T)
        return src, tgt
    flow = transport(cost, np.ones(rows), np.ones(columns))
    return np.nonzero(flow)


def integral_assignment(cost: np.ndarray) -> np.ndarray:
    """Source unit of every target unit; sources are used as evenly as possible."""

    sources, targets = cost.shape
    share, rest = divmod(targets, sources)
    # one flow from targets to sources: the even share first, at a rebate that beats any detour, then
    # one more unit per source for what is left over
    rebate = (np.ptp(cost) + 1.0) * targets if share and rest else 0.0
    choices = [cost.T - rebate] * bool(share) + [cost.T] * bool(rest)
    room = [np.full(sources, share)] * bool(share) + [np.ones(sources)] * bool(rest)
    flow = transport(np.hstack(choices), np.ones(targets), np.concatenate(room))
    return flow.argmax(axis=1) % sources


def barycentric_amounts(cost: np.ndarray) -> np.ndarray:
    """Exact transport between two uniform distributions."""

    rows, columns = cost.shape
    shared = gcd(rows, columns)
    flow = transport(cost, np.full(rows, columns // shared), np.full(columns, rows // shared))
    return flow / flow.sum()


def _plans(cost_rows: DataFrame, by: Sequence[str], solve) -> DataFrame:
    by = list(by)
    fields = [cost_rows.schema[name] for name in by]
    schema = T.StructType(
        fields
        + [
            T.StructField("src", T.IntegerType()),
            T.StructField("tgt", T.IntegerType()),
            T.StructField("mass", T.DoubleType()),
        ]
    )

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        cost = np.full((frame["src"].max() + 1, frame["tgt"].max() + 1), np.nan)
        cost[frame["src"], frame["tgt"]] = frame["cost"]
        if np.isnan(cost).any():
            raise ValueError("the cost table has holes or NaN cells")
        plan = solve(cost)
        out = _grid(plan, "mass", plan > 0)
        for position, name in enumerate(by):
            out.insert(position, name, [key[position]] * len(out))
        return out

    source = cost_rows if by else cost_rows.withColumn("_all", F.lit(0))
    return source.groupBy(*(by or ["_all"])).applyInPandas(run, schema)


def integral_plan(cost_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each target takes its whole mass from one source; groups are solved in parallel."""

    def solve(cost: np.ndarray) -> np.ndarray:
        owner = integral_assignment(cost)
        plan = np.zeros(cost.shape)
        plan[owner, np.arange(cost.shape[1])] = 1.0 / cost.shape[1]
        return plan

    return _plans(cost_rows, by, solve)


def barycentric_plan(cost_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _plans(cost_rows, by, barycentric_amounts)


# ---------------------------------------------------------------- operators on plans


def operators_from_plan(plan: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``analysis`` (columns sum to one) and ``synthesis`` (rows sum to one)."""

    into = Window.partitionBy(*by, "tgt")
    out_of = Window.partitionBy(*by, "src")
    floor = F.lit(FLOOR)
    return plan.withColumn(
        "analysis", F.col("mass") / F.greatest(F.sum("mass").over(into), floor)
    ).withColumn("synthesis", F.col("mass") / F.greatest(F.sum("mass").over(out_of), floor))


def self_mass(ops: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ops.groupBy(*by, "src").agg(
        F.sum(F.col("synthesis") * F.col("analysis")).alias("self_mass")
    )


def argmax_source(ops: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per target the source with most mass; the lowest index on ties."""

    return ops.groupBy(*by, "tgt").agg(
        F.max_by("src", F.struct(F.col("analysis"), -F.col("src"))).alias("src")
    )


def identity_agreement(ops: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of targets that draw on their own index; NaN when the sizes differ."""

    keys = list(by) or ["_all"]
    marked = ops if by else ops.withColumn("_all", F.lit(0))
    sizes = marked.groupBy(*keys).agg(F.max("src").alias("_s"), F.max("tgt").alias("_t"))
    hits = argmax_source(marked, keys).groupBy(*keys).agg(
        F.avg((F.col("src") == F.col("tgt")).cast("double")).alias("_hit")
    )
    value = F.when(F.col("_s") == F.col("_t"), F.col("_hit")).otherwise(F.lit(float("nan")))
    return hits.join(sizes, keys).select(*by, value.alias("identity_agreement"))


def match_summary(cost_rows: DataFrame, plan: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per group: is doing nothing as cheap as the plan?

    Cost and plan are d x d tables; the row counts here do not depend on the data.
    """

    by = list(by)
    ops = operators_from_plan(plan, by)
    cells = cost_rows.join(ops, [*by, "src", "tgt"], "left")
    cells = cells.withColumn("_own", F.col("synthesis") * F.col("analysis"))
    # best source per target and self mass per source, as windows over d x d cells
    per_target = Window.partitionBy(*by, "tgt").orderBy(
        F.coalesce("analysis", F.lit(0.0)).desc(), "src"
    )
    cells = cells.withColumn("_best", F.row_number().over(per_target) == 1)
    per_source = cells.groupBy(*by, "src").agg(
        F.coalesce(F.sum("_own"), F.lit(0.0)).alias("_self"),
        F.sum(F.col("cost") * F.coalesce("mass", F.lit(0.0))).alias("_moved"),
        F.sum(F.when(F.col("src") == F.col("tgt"), F.col("cost"))).alias("_diag"),
        F.sum((F.col("_best") & (F.col("src") == F.col("tgt"))).cast("int")).alias("_same"),
        F.count(F.lit(1)).alias("_targets"),
    )
    square = F.count(F.lit(1)) == F.max("_targets")
    nan = F.lit(float("nan"))
    return per_source.groupBy(*by).agg(
        F.count(F.lit(1)).alias("source_size"),
        F.max("_targets").alias("target_size"),
        F.sum("_moved").alias("transport_cost"),
        F.when(square, F.avg("_diag")).otherwise(nan).alias("identity_cost"),
        F.when(square, F.sum("_same") / F.max("_targets")).otherwise(nan).alias("identity_agreement"),
        F.avg("_self").alias("mean_self_mass"),
        F.min("_self").alias("min_self_mass"),
    )


def expand_ops(ops: DataFrame, factor: int) -> DataFrame:
    """Repeat every unit ``factor`` times and keep the place within the unit."""

    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    spread = ops.withColumn("_r", F.explode(steps))
    return spread.withColumn("src", F.col("src") * factor + F.col("_r")).withColumn(
        "tgt", F.col("tgt") * factor + F.col("_r")
    ).drop("_r")


def concat_ops(parts: Sequence[tuple[DataFrame, int, int]]) -> DataFrame:
    """Block-diagonal: each part is ``(ops, source_size, target_size)``."""

    out, src_at, tgt_at = None, 0, 0
    for ops, n_src, n_tgt in parts:
        moved = ops.withColumn("src", F.col("src") + src_at).withColumn("tgt", F.col("tgt") + tgt_at)
        out = moved if out is None else out.unionByName(moved)
        src_at, tgt_at = src_at + n_src, tgt_at + n_tgt
    return out


def identity_ops(spark, size: int) -> DataFrame:
    return spark.range(size).select(
        F.col("id").cast("int").alias("src"),
        F.col("id").cast("int").alias("tgt"),
        F.lit(1.0 / size).alias("mass"),
        F.lit(1.0).alias("analysis"),
        F.lit(1.0).alias("synthesis"),
    )


def block_contributions(
    frames: DataFrame, keys: Sequence[str], weight: np.ndarray, blocks: int, x: str = "x"
) -> DataFrame:
    """Each block's additive part of ``x @ weight``: ``(keys..., block, v)``.

    ``weight`` is (width, out); block ``h`` uses its own slice of rows. Done per Arrow batch,
    so the contributions never pass through an exploded (row, position, out) table.
    """

    keys = list(keys)
    if weight.shape[0] % blocks:
        raise ValueError(f"width {weight.shape[0]} does not split into {blocks} blocks")
    size = weight.shape[0] // blocks
    schema = T.StructType(
        [frames.schema[k] for k in keys]
        + [T.StructField("block", T.IntegerType()), T.StructField("v", T.ArrayType(T.DoubleType()))]
    )

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values = matrix(batch.column(x))
            for block in range(blocks):
                part = slice(block * size, (block + 1) * size)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(k) for k in keys],
                        pa.array(np.full(len(values), block, dtype=np.int32)),
                        list_array(values[:, part] @ weight[part]),
                    ],
                    names=[*keys, "block", "v"],
                )

    return frames.select(*keys, x).mapInArrow(run, schema)


def block_unit_moments(
    pairs: DataFrame,
    source_weight: np.ndarray,
    target_weight: np.ndarray,
    blocks: int,
    basis: np.ndarray | None = None,
) -> DataFrame:
    """Moments with blocks as units: two blocks are alike when they add alike vectors.

    Each (row, output) cell is one feature. ``basis`` is the analysis matrix that brings the
    source outputs into the target's order. Features are reduced inside the Arrow batch.
    """

    def features(values: np.ndarray, weight: np.ndarray, turn: np.ndarray | None) -> np.ndarray:
        size = weight.shape[0] // blocks
        parts = []
        for block in range(blocks):
            rows = slice(block * size, (block + 1) * size)
            part = values[:, rows] @ weight[rows]
            parts.append((part if turn is None else part @ turn).ravel())
        return np.stack(parts, axis=1)

    def run(batches):
        sums = PartialSums(blocks, blocks, False)
        for batch in batches:
            if batch.num_rows:
                sums.add(
                    features(matrix(batch.column("x")), source_weight, basis),
                    features(matrix(batch.column("y")), target_weight, None),
                )
        if sums.n:
            yield PartialSums.batch({(): sums}, [], [])

    partial = pairs.select("x", "y").mapInArrow(run, T.StructType(PARTIAL_FIELDS))
    return sum_cells(partial.repartition("kind", "i"))
