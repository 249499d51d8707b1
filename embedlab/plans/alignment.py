"""The alignment reports: ladder, penalty sweep, what-ifs, fused checkpoints."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedlab.operators import fits, scoring
from embedlab.operators.fits import RIDGE_ALPHAS, LinearMap
from embedlab.operators.matching import (
    integral_assignment,
    integral_plan,
    match_summary,
    unit_cost,
    unit_distances,
)
from embedlab.operators.moments import MomentMatrices, moments
from embedlab.operators.sampling import group_holdout
from embedlab.session import materialize

# What a report keeps of each penalty.
SWEEP_FIELDS = ("alpha", "r2", "relative_error", "cosine_mean", "cosine_p05", "deployed_r2")


@dataclass
class Split:
    """Held-out rows and the two sets of d x d matrices of one run."""

    held_out: DataFrame
    fit: MomentMatrices
    held: MomentMatrices


def split_moments(pairs: DataFrame, key: str = "grp", fraction: float = 0.2) -> DataFrame:
    """Moments of both halves in one pass over the pairs."""

    return moments(group_holdout(pairs, key, fraction), by=["split"], full_yy=True)


def split_pairs(pairs: DataFrame, key: str = "grp", fraction: float = 0.2) -> Split:
    halves = group_holdout(pairs, key, fraction)
    matrices = fits.collect_moments(moments(halves, by=["split"], full_yy=True), "split")
    return Split(halves.filter("split = 'eval'"), matrices["fit"], matrices["eval"])


def matched_sources(m: MomentMatrices, metric: str = "correlation") -> list[int]:
    """Source unit of each target unit under the least-cost matching; d x d work."""

    return [int(v) for v in integral_assignment(unit_distances(m, metric))]


def score_maps(
    pairs: DataFrame, names: Sequence[str], alphas: Sequence[float] = RIDGE_ALPHAS
) -> DataFrame:
    """Fit on one half, score on the other, without a projection."""

    halves = split_pairs(pairs)
    source_of = matched_sources(halves.fit) if "permutation" in names else None
    maps = fits.fit(halves.fit, names, alphas, source_of)
    return scoring.score_rows(halves.held_out, maps)


def _both_scores(halves: Split, maps: Sequence[LinearMap], projection) -> DataFrame:
    """Plain and deployed scores of all maps against the projected target.

    Both kinds of map are stacked, so the held-out rows are read once.
    """

    p, pb = projection
    target = scoring.project(halves.held_out.select("x", "y"), p, pb, "y", "y")
    plain = [scoring.lifted_map(m, len(pb), projection) for m in maps]
    shipped = [scoring.deployed_map(m, p, pb) for m in maps]
    count = len(maps)
    for position, (a, b) in enumerate(zip(plain, shipped)):
        a.ord, b.ord = position, count + position
    scores = scoring.score_rows(target, [*plain, *shipped])
    place = F.pmod(F.col("ord"), F.lit(count))
    deployed = F.col("ord") >= count
    one = lambda c, late: F.max(F.when(deployed if late else ~deployed, F.col(c)))
    return scores.groupBy(place.alias("ord")).agg(
        one("map", False).alias("map"),
        one("alpha", False).alias("alpha"),
        one("r2", False).alias("r2"),
        one("relative_error", False).alias("relative_error"),
        one("cosine_mean", False).alias("cosine_mean"),
        one("cosine_p05", False).alias("cosine_p05"),
        one("r2", True).alias("deployed_r2"),
        one("cosine_mean", True).alias("deployed_cosine_mean"),
    )


def ridge_sweep(
    pairs: DataFrame, projection=None, alphas: Sequence[float] = RIDGE_ALPHAS
) -> DataFrame:
    """One row per penalty with ``is_best`` and ``at_edge``."""

    halves = split_pairs(pairs)
    maps = fits.fit(halves.fit, ["ridge"], alphas)
    if projection is None:
        scores = scoring.score_rows(halves.held_out, maps).withColumn(
            "deployed_r2", F.lit(None).cast("double")
        )
    else:
        scores = _both_scores(halves, maps, projection)
    return scoring.flag_best_alpha(scores)


def ladder(
    pairs: DataFrame, projection, alphas: Sequence[float] = RIDGE_ALPHAS
) -> DataFrame:
    """Every rung with plain and deployed scores; ridge is its best penalty.

    ``(ord, map, alpha, r2, ..., deployed_cosine_mean, shippable)``, in ladder order.
    """

    halves = split_pairs(pairs)
    names = ["identity", "permutation", "diagonal", "orthogonal", "ridge"]
    maps = fits.fit(halves.fit, names, alphas, matched_sources(halves.fit))
    scores = _both_scores(halves, maps, projection)
    swept = scoring.flag_best_alpha(scores.withColumn("_ridge", F.col("map") == "ridge"), ["_ridge"])
    return (
        swept.filter(~F.col("_ridge") | F.col("is_best"))
        .withColumn("shippable", F.lit(None).cast("boolean"))
        .drop("_ridge", "is_best", "at_edge")
    )


def with_sweep(rungs: DataFrame, sweep: DataFrame) -> DataFrame:
    """The rungs with ``sweep``: for maps that were chosen from several penalties, all of them, in order.

    ``sweep`` has a row per map and penalty, so its arrays are as long as the grid.
    """

    fields = [c for c in SWEEP_FIELDS if c in sweep.columns]
    traces = sweep.groupBy("map").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("sweep"))
    return rungs.join(traces, "map", "left")


def report_only_rung(
    pairs: DataFrame, head: Sequence, projection, alphas: Sequence[float] = RIDGE_ALPHAS
) -> DataFrame:
    """The best ridge fitted behind a two-layer head: worth measuring, not shippable.

    ``head`` is ``(w1, b1, w2, b2)``. The head is applied once, ahead of both halves.
    """

    turned = scoring.mlp_scores(pairs, *head, x="x", out="x")
    halves = split_pairs(turned)
    scores = _both_scores(halves, fits.fit(halves.fit, ["ridge"], alphas), projection)
    best = scoring.flag_best_alpha(scores).filter("is_best").drop("is_best", "at_edge")
    return best.withColumn("map", F.lit("head+ridge")).withColumn("shippable", F.lit(False))


def ladder_with_best(pairs: DataFrame, projection, head: Sequence | None = None) -> DataFrame:
    """The ladder with the map to ship flagged, and the report-only rung if there is a head.

    One row per rung, so the window over all of them is tiny.
    """

    rungs = ladder(pairs, projection)
    if head is not None:
        extra = report_only_rung(pairs, head, projection)
        rungs = rungs.unionByName(extra.withColumn("ord", F.lit(1000)))
    criterion = F.coalesce("deployed_r2", "r2")
    usable = F.coalesce("shippable", F.lit(True)) & ~F.isnan(criterion)
    order = Window.partitionBy(F.lit(0)).orderBy(
        F.when(usable, criterion).desc_nulls_last(), "ord"
    )
    return rungs.withColumn("is_best", (F.row_number().over(order) == 1) & usable)


def chosen_projection(pairs: DataFrame, projection, alphas: Sequence[float] = RIDGE_ALPHAS):
    """The map the ladder would ship, folded: ``(name, (weight, bias), fit rows)``."""

    halves = split_pairs(pairs)
    names = ["identity", "permutation", "diagonal", "orthogonal", "ridge"]
    maps = fits.fit(halves.fit, names, alphas, matched_sources(halves.fit))
    scores = _both_scores(halves, maps, projection).withColumn("shippable", F.lit(None).cast("boolean"))
    best = scoring.best_map(scores).first()
    chosen = maps[best["ord"]]
    return chosen.name, chosen.fold_into_projection(*projection), int(halves.fit.n)


def unit_costs(pairs: DataFrame, by: Sequence[str], metric: str = "correlation") -> DataFrame:
    """Unit costs per group, kept like the moments behind them: d x d cells are read again instead of the pairs."""

    return materialize(unit_cost(materialize(moments(pairs, by)), metric, by))


def transport_table(pairs: DataFrame, by: Sequence[str], metric: str = "correlation") -> DataFrame:
    """Per group: are the units of the two sides numbered the same way?"""

    cost = unit_costs(pairs, by, metric)
    return match_summary(cost, integral_plan(cost, by), by)


def ladder_from_moments(
    moment_rows: DataFrame, names: Sequence[str], by: Sequence[str] = (),
    alphas: Sequence[float] = RIDGE_ALPHAS,
) -> DataFrame:
    """R2 of every map on held-out moments; no row is read again.

    Expects moments by ``(by..., split)`` with the ``syy`` diagonal. Groups run in parallel.
    """

    by = list(by)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        half = {name: MomentMatrices(part) for name, part in frame.groupby("split")}
        source_of = matched_sources(half["fit"]) if "permutation" in names else None
        out = [
            (m.name, m.alpha, scoring.score_from_moments(m, half["eval"]))
            for m in fits.fit(half["fit"], names, alphas, source_of)
        ]
        result = pd.DataFrame(out, columns=["map", "alpha", "r2"]).astype({"alpha": "float64"})
        for position, name in enumerate(by):
            result.insert(position, name, [key[position]] * len(result))
        return result

    schema = T.StructType(
        [moment_rows.schema[name] for name in by]
        + list(T._parse_datatype_string("map string, alpha double, r2 double").fields)
    )
    source = moment_rows if by else moment_rows.withColumn("_all", F.lit(0))
    return source.groupBy(*(by or ["_all"])).applyInPandas(run, schema)


def map_weights(
    pairs: DataFrame, names: Sequence[str], by: Sequence[str] = (), alphas=RIDGE_ALPHAS, widths=None
) -> DataFrame:
    """``(by..., map, alpha, i, j, w)`` of maps fitted on all rows."""

    return fits.map_cells(fits.fit_maps(moments(pairs, by, widths=widths), names, by, alphas), by)

