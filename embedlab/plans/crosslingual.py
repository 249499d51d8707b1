"""Parallel-corpus retrieval over several languages and probes in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlab.operators import fits
from embedlab.operators.moments import moments
from embedlab.operators.retrieval import (
    center_and_normalize,
    mean_pool,
    rank_matched,
    retrieval_summary,
)
from embedlab.operators.pairing import existing_only, first_last_take
from embedlab.operators.scoring import apply_map, apply_maps, projection_map
from embedlab.session import materialize


def probe_sets(frames: DataFrame, width: int, alpha: float = 0.01) -> DataFrame:
    """``(language, probe, utt, v, r)``: a probe vector and its reference per utterance.

    Frames are pooled once and the pooled table is kept; the mapped probe is the map of the
    pooled frame, which equals the pooled mapped frames because the map is affine.
    """

    backward = fits.collect_moments(moments(frames, x="y", y="x"))[None]
    mapped = fits.ridge_map(backward, alpha)
    pooled = mean_pool(frames, ["lang", "utt"], ["x", "y"], width)
    turned = apply_map(pooled, mapped, "y", "m")
    each = F.array(
        *[
            F.struct(F.lit(name).alias("probe"), F.col(column).alias("v"), F.col("x").alias("r"))
            for name, column in (("raw", "y"), ("map", "m"), ("same", "x"))
        ]
    )
    return materialize(turned.select(F.col("lang").alias("language"), "utt", F.inline(each)))


def ranks(sets: DataFrame, width: int) -> DataFrame:
    by = ["language", "probe"]
    return rank_matched(materialize(center_and_normalize(sets, by, ["v", "r"], width)), by, "utt", width)


def retrieval_table(frames: DataFrame, width: int, alpha: float = 0.01) -> DataFrame:
    placed = materialize(ranks(probe_sets(frames, width, alpha), width))
    return retrieval_summary(placed, ["language", "probe"])


def takes_retrieval(
    takes: DataFrame, files: DataFrame, frames: DataFrame, reference: str, projection, aligned
) -> DataFrame:
    """The retrieval table from a manifest of takes and the frames of each file.

    ``frames`` is ``(path, x, y)``: baseline and swapped-in vectors of the same file. Against
    the first take of each sentence in the reference language, the probes are its last take
    (the ceiling), the other language through the baseline, and through the swapped-in vectors
    with the old and with the aligned projection. Languages without a shared sentence have no
    rows. ``n_single_take`` counts sentences whose ceiling probe is the reference itself.
    """

    present = existing_only(takes, files)
    spoken = first_last_take(present)
    anchors = spoken.filter(F.col("lang") == reference).select(
        "sentence_id",
        F.col("first_take").alias("_ref"),
        F.col("last_take").alias("_second"),
        (F.col("n_takes") == 1).cast("bigint").alias("single"),
    )
    others = spoken.filter(F.col("lang") != reference).select(
        F.col("lang").alias("language"), "sentence_id", F.col("first_take").alias("_own")
    )
    shared = others.join(anchors, "sentence_id")
    # pool only files that are used, once each
    used = shared.select(F.explode(F.array("_own", "_ref", "_second")).alias("path")).distinct()
    pooled = materialize(mean_pool(frames.join(used, "path", "left_semi"), ["path"], ["x", "y"]))

    def take(column: str, **names: str) -> DataFrame:
        return pooled.select(F.col("path").alias(column), *[F.col(k).alias(v) for k, v in names.items()])

    vectors = (
        shared.join(take("_own", x="_ox", y="_oy"), "_own")
        .join(take("_ref", x="_rx"), "_ref")
        .join(take("_second", x="_sx"), "_second")
        .select("language", "sentence_id", "single", "_ox", "_oy", "_rx", "_sx")
    )
    old, new = projection_map(*projection), projection_map(*aligned)
    lifted = apply_maps(
        vectors,
        [
            (old, "_rx", "r"), (old, "_sx", "second"), (old, "_ox", "base"),
            (old, "_oy", "raw"), (new, "_oy", "map"),
        ],
    )
    each = F.array(
        *[
            F.struct(F.lit(label).alias("probe"), F.col(column).alias("v"))
            for label, column in (
                ("second take", "second"), ("baseline", "base"), ("swapped", "raw"), ("swapped+map", "map"),
            )
        ]
    )
    sets = materialize(lifted.select("language", "sentence_id", "single", "r", F.inline(each)))
    by = ["language", "probe"]
    placed = materialize(
        rank_matched(materialize(center_and_normalize(sets.drop("single"), by, ["v", "r"])), by, "sentence_id")
    )
    singles = sets.groupBy(*by).agg(F.sum("single").alias("n_single_take"))
    return retrieval_summary(placed, by).join(singles, by)
