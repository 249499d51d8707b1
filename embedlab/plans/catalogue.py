"""Registered queries: each takes a session and a data folder and returns a DataFrame."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from embedlab.functions import quant
from embedlab.functions import vectors as V
from embedlab.functions.sql import register_sql_functions
from embedlab.functions.vectors import round_metric as r6
from embedlab.operators import (
    auction,
    fits,
    matching,
    pairing,
    parity,
    retrieval,
    sampling,
    scoring,
    signals,
    tensors,
)
from embedlab.operators import moments as mom
from embedlab.operators.ordering import stable_order
from embedlab.plans import alignment, crosslingual, views
from embedlab.session import fresh_path, materialize
from embedlab.sources import readers, writers
from embedlab.sources.tables import read_table
from embedlab.streaming import statistics

LADDER_NAMES = ["identity", "permutation", "diagonal", "orthogonal", "ridge"]
SMALL_FFT, SMALL_WINDOW, SMALL_HOP, SMALL_MELS = 16, 12, 4, 4
FIR_KERNEL = (0.5, 0.25, 0.125, 0.0625, 0.0625)
LEFT = 3
LAMBDAS = (0.0, 0.25, 0.5, 0.75, 1.0)
BLOCKS = 8
FILE_ROWS = 100_000


def _r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for column in columns:
        df = df.withColumn(column, r6(F.col(column), digits))
    return df


def _long(df: DataFrame, *columns: str) -> DataFrame:
    for column in columns:
        df = df.withColumn(column, F.col(column).cast("bigint"))
    return df


# ------------------------------------------------------------ selection and splitting


def pairs_checksum(spark: SparkSession, d: str) -> DataFrame:
    pairs = views.pairs(spark, d)
    on = ["grp", "vec_id"]
    joined = pairing.pair_frames(pairs.select(*on, "x"), pairs.select(*on, "y"), on)
    out = joined.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(V.total(F.col("x"))).alias("sum_x"),
        F.sum(V.total(F.col("y"))).alias("sum_y"),
    )
    return _r(out, "sum_x", "sum_y")


def recording_sample(spark: SparkSession, d: str) -> DataFrame:
    recordings = sampling.require_rate(views.recordings(spark, d), views.RATE)
    want = sampling.wanted_samples(views.CROP / views.RATE, views.RATE)
    clips = sampling.sample_clips(recordings, want, views.RATE, limit=100, seed=0)
    return clips.select("path", "offset", sampling.duration(F.col("n_samples"), views.RATE).alias("seconds"))


def recording_groups(spark: SparkSession, d: str) -> DataFrame:
    recordings = sampling.with_group_key(views.recordings(spark, d))
    usable = sampling.filter_min_length(recordings, views.CROP)
    out = usable.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(sampling.duration(F.col("n_samples"), views.RATE)).alias("seconds"),
        F.sum(
            sampling.wanted_samples_col(F.col("n_samples") / 8.0, F.lit(1.0))
        ).alias("eighths"),
    )
    return _r(out, "seconds", digits=3)


def holdout_counts(spark: SparkSession, d: str) -> DataFrame:
    keyed = sampling.with_group_key(views.recordings(spark, d))
    return sampling.holdout_counts(sampling.group_holdout(keyed, "grp"), "grp")


def crop_text(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select(
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".flac"))).alias("path"),
        F.col("n_chars").alias("n_samples"),
        "text",
    )
    long_enough = sampling.filter_min_length(docs, views.CROP)
    offset = sampling.crop_offset(F.col("n_samples"), views.CROP, views.RATE)
    return long_enough.select("path", sampling.crop_text(F.col("text"), offset, views.CROP).alias("crop"))


def batch_sizes(spark: SparkSession, d: str) -> DataFrame:
    batched = sampling.batches(views.recordings(spark, d), 64, ["path"])
    return batched.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"), F.max("path").alias("last_path")
    )


def capped_rows(spark: SparkSession, d: str) -> DataFrame:
    frames = views.utterances(spark, d).select("utt", "frame")
    return sampling.cap_rows(frames, 300, ["utt", "frame"])


def frame_units(spark: SparkSession, d: str) -> DataFrame:
    frames = views.utterances(spark, d)
    units = sampling.explode_units(frames, "x", ["lang", "utt", "frame"])
    out = units.groupBy("lang", "unit").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.max("v").alias("top")
    )
    return _r(_long(out, "unit"), "total", "top")


def rate_quarantine(spark: SparkSession, d: str) -> DataFrame:
    recordings = views.recordings(spark, d).withColumn(
        "rate", F.when(F.col("n_samples") % 7 == 0, 8000).otherwise(views.RATE)
    )
    checked = sampling.quarantine_rate(recordings, views.RATE)
    return checked.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def downmix(spark: SparkSession, d: str) -> DataFrame:
    return _r(sampling.downmix(views.stereo(spark, d)), "v")


def hook_groups(spark: SparkSession, d: str) -> DataFrame:
    pairs = views.pairs(spark, d)
    label = F.col("grp").cast("int")
    key = F.when(label < 3, F.concat(F.lit("residual.block."), "grp")).otherwise(
        F.concat(F.lit("block."), "grp", F.lit(".ffn1"))
    )
    kind = F.when(label < 3, "residual").when(label < 8, "ffn").otherwise("conv")
    keyed = pairs.withColumn("key", key).withColumn("kind", kind)
    wanted = pairing.select_groups(keyed, "residual,ffn")
    matched = pairing.match_hook_points(
        wanted.select("key", "vec_id", "x"), keyed.select("key", "vec_id", "y"), ["key", "vec_id"]
    )
    out = matched.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), F.sum(V.dot(F.col("x"), F.col("y"))).alias("cross")
    )
    return _r(out, "cross")


# ------------------------------------------------------------ moments and maps


def moments_long(spark: SparkSession, d: str) -> DataFrame:
    pairs = views.lineitem_pairs(spark, d)
    table = mom.moments(pairs, full_yy=True, widths=(4, 4))
    return _r(_long(table, "i", "j"), "v", digits=4)


def merged_moments(spark: SparkSession, d: str) -> DataFrame:
    pairs = views.lineitem_pairs(spark, d)
    per_group = mom.moments(pairs, by=["grp"], widths=(4, 4))
    return _r(_long(mom.merge_moments(per_group), "i", "j"), "v", digits=4)


def moments_wide(spark: SparkSession, d: str) -> DataFrame:
    table = mom.moments(views.pairs(spark, d), by=["grp"])
    return _r(_long(table, "i", "j"), "v")


def covariance(spark: SparkSession, d: str) -> DataFrame:
    table = mom.moments(views.lineitem_pairs(spark, d), widths=(4, 4))
    return _r(_long(mom.centered(table), "i", "j"), "cxx", "cxy")


def _scores(spark: SparkSession, d: str, names: list[str]) -> DataFrame:
    out = alignment.score_maps(views.pairs(spark, d), names)
    out = _r(out, "r2", "relative_error", "cosine_mean", "cosine_p05")
    return out.select("map", "r2", "relative_error", "cosine_mean", "cosine_p05")


def diagonal_score(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, ["diagonal"])


def identity_score(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, ["identity"])


def permutation_score(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, ["permutation"])


def orthogonal_score(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, ["orthogonal"])


def ridge_score(spark: SparkSession, d: str) -> DataFrame:
    sweep = alignment.ridge_sweep(views.pairs(spark, d))
    out = _r(sweep, "r2", "relative_error", "cosine_mean", "cosine_p05")
    return out.select("alpha", "r2", "relative_error", "cosine_mean", "cosine_p05", "is_best", "at_edge")


def ridge_sweep(spark: SparkSession, d: str) -> DataFrame:
    sweep = alignment.ridge_sweep(views.pairs(spark, d), views.projection_matrix())
    out = _r(sweep, "r2", "deployed_r2", "deployed_cosine_mean", digits=5)
    return out.select("alpha", "r2", "deployed_r2", "deployed_cosine_mean", "is_best", "at_edge")


def ridge_by_group(spark: SparkSession, d: str) -> DataFrame:
    weights = alignment.map_weights(
        views.lineitem_pairs(spark, d), ["ridge"], ["grp"], [0.1], widths=(4, 4)
    )
    return _r(_long(weights, "i", "j"), "w").select("grp", "i", "j", "w")


def map_weights(spark: SparkSession, d: str) -> DataFrame:
    weights = alignment.map_weights(
        views.pairs(spark, d), ["identity", "diagonal", "orthogonal"]
    )
    return _r(_long(weights, "i", "j"), "w").select("map", "i", "j", "w")


def procrustes_orthogonality(spark: SparkSession, d: str) -> DataFrame:
    table = mom.moments(views.pairs(spark, d), by=["grp"])

    def check(m: mom.MomentMatrices) -> pd.DataFrame:
        mapping = fits.orthogonal_map(m)
        gram = mapping.weight.T @ mapping.weight / mapping.scale**2
        off = float(np.abs(gram - np.eye(m.dx)).max())
        return pd.DataFrame({"n": [int(m.n)], "orthogonal": [off < 1e-9]})

    return mom.per_group(table, ["grp"], check, "n bigint, orthogonal boolean")


def score_from_moments(spark: SparkSession, d: str) -> DataFrame:
    halves = alignment.split_moments(views.pairs(spark, d))
    out = alignment.ladder_from_moments(halves, ["identity", "diagonal", "ridge"], alphas=[0.01])
    return _r(out, "r2").select("map", "r2")


def group_ladder(spark: SparkSession, d: str) -> DataFrame:
    """R2 per map and supplier group of line items, all groups at once, from moments alone."""

    pairs = views.lineitem_pairs(spark, d)
    # every fifth price is held out, so each group has both halves
    half = F.when(F.rint(F.col("x")[1] * 100000) % 5 == 0, "eval").otherwise("fit")
    table = mom.moments(pairs.withColumn("split", half), ["grp", "split"], widths=(4, 4))
    out = alignment.ladder_from_moments(table, ["identity", "diagonal"], ["grp"])
    return _r(out, "r2").select("grp", "map", "r2")


def _ladder(spark: SparkSession, d: str) -> DataFrame:
    return alignment.ladder_with_best(views.pairs(spark, d), views.projection_matrix())


def ladder(spark: SparkSession, d: str) -> DataFrame:
    columns = ["r2", "relative_error", "cosine_mean", "cosine_p05", "deployed_r2", "deployed_cosine_mean"]
    return _r(_ladder(spark, d), *columns, digits=5).select("map", "alpha", *columns, "is_best")


def _grid(rows: int, columns: int, a: int, b: int, modulus: int) -> np.ndarray:
    values = np.add.outer(np.arange(rows) * a, np.arange(columns) * b) % modulus
    return (values - modulus // 2) / modulus


def ladder_with_head(spark: SparkSession, d: str) -> DataFrame:
    """The ladder with an extra rung behind a two-layer head, which never wins."""

    head = (_grid(32, 64, 5, 3, 37), np.arange(32) / 64.0, _grid(64, 32, 7, 11, 29), np.arange(64) / 32.0)
    out = alignment.ladder_with_best(views.pairs(spark, d), views.projection_matrix(), head)
    return _r(out, "r2", "deployed_r2", digits=4).select("map", "r2", "deployed_r2", "shippable", "is_best")


def best_map(spark: SparkSession, d: str) -> DataFrame:
    rungs = alignment.ladder(views.pairs(spark, d), views.projection_matrix())
    return _r(scoring.best_map(rungs), "r2", "deployed_r2", digits=5).select("map", "r2", "deployed_r2")


def deployed_score(spark: SparkSession, d: str) -> DataFrame:
    halves = alignment.split_pairs(views.pairs(spark, d))
    p, pb = views.projection_matrix()
    maps = fits.fit(halves.fit, ["identity", "diagonal"])
    target = scoring.project(halves.held_out.select("x", "y"), p, pb, "y", "y")
    scores = scoring.score_deployed(target, maps, (p, pb))
    names = F.create_map(*[v for m in maps for v in (F.lit(m.ord), F.lit(m.name))])
    return _r(scores, "deployed_r2", "deployed_cosine_mean", digits=5).select(
        names[F.col("ord")].alias("map"), "deployed_r2", "deployed_cosine_mean"
    )


def report_lines(spark: SparkSession, d: str) -> DataFrame:
    return writers.report_lines(_ladder(spark, d)).select("line")


def normalisation_what_if(spark: SparkSession, d: str) -> DataFrame:
    """The ladder's R2 with and without per-feature normalisation of the source."""

    pairs = sampling.group_holdout(views.pairs(spark, d), "grp")
    scaled = signals.normalize_channels(pairs, ["grp"], "x")
    both = pairs.select("split", "x", "y", F.lit(False).alias("normalized")).unionByName(
        scaled.select("split", "x", "y", F.lit(True).alias("normalized"))
    )
    table = mom.moments(both, ["normalized", "split"])
    out = alignment.ladder_from_moments(table, ["identity", "diagonal", "ridge"], ["normalized"], [0.01])
    return _r(out, "r2", digits=5).select("normalized", "map", "r2")


# ------------------------------------------------------------ quantisation


def q8_codes(spark: SparkSession, d: str) -> DataFrame:
    vectors = read_table(spark, d, "embeddings").select("vec_id", V.as_doubles(F.col("embedding")).alias("x"))
    blocks = vectors.select("vec_id", F.posexplode(quant.split_blocks(F.col("x"))).alias("block", "v"))
    sized = blocks.withColumn("peak", quant.block_peak(F.col("v")))
    codes = quant.block_codes(F.col("v"), F.col("peak"))
    return sized.select(
        "vec_id",
        F.col("block").cast("bigint").alias("block"),
        quant.block_scale(F.col("peak")).alias("scale"),
        F.array_join(F.transform(codes, lambda c: c.cast("int").cast("string")), " ").alias("codes"),
    )


def q8_loss(spark: SparkSession, d: str) -> DataFrame:
    vectors = read_table(spark, d, "embeddings").select("vec_id", V.as_doubles(F.col("embedding")).alias("x"))
    restored = vectors.withColumn("q", quant.q8_0(F.col("x")))
    twice = restored.withColumn("qq", quant.q8_0(F.col("q")))
    gap = lambda a, b: F.array_max(F.zip_with(a, b, lambda u, v: F.abs(u - v)))
    out = twice.select(
        "vec_id", gap("x", "q").alias("max_abs_err"), (gap("q", "qq") == 0.0).alias("idempotent")
    )
    return _r(out, "max_abs_err")


def f16_round(spark: SparkSession, d: str) -> DataFrame:
    vectors = read_table(spark, d, "embeddings").select("vec_id", V.as_doubles(F.col("embedding")).alias("x"))
    cells = vectors.select("vec_id", F.posexplode("x").alias("i", "x"))
    return cells.select("vec_id", F.col("i").cast("bigint").alias("i"), quant.f16(F.col("x")).alias("h"))


def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The scalar functions as a SQL user calls them."""

    register_sql_functions(spark)
    pairs = views.pairs(spark, d)
    called = pairs.selectExpr(
        "vec_id", "f16(y[0]) AS first_half", "cosine(x, y) AS cos", "cosine(x, q8_0(x)) AS kept"
    )
    return _r(called, "cos", "kept")


def deployed_tensors(spark: SparkSession, d: str) -> DataFrame:
    rounded = tensors.as_deployed(_base(spark, d).withColumn("ndim", F.lit(2)))
    out = rounded.groupBy("name").agg(
        F.sum(V.total(F.col("values"))).alias("total"),
        F.sum(V.squared_norm(F.col("values"))).alias("energy"),
    )
    return _r(out, "total", "energy")


# ------------------------------------------------------------ retrieval


def scan_recordings(spark: SparkSession, d: str) -> DataFrame:
    """Files written per source and language, found again by listing alone."""

    root = fresh_path(spark, "recordings")
    docs = read_table(spark, d, "documents").select("source", "lang", "text")
    docs.write.partitionBy("source", "lang").text(root)
    listed = readers.scan_recordings(spark, root, "*.txt")
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1).alias(name)
    return listed.groupBy(part("source"), part("lang")).agg(F.sum("length").alias("total_bytes"))


def scan_takes(spark: SparkSession, d: str) -> DataFrame:
    """Manifests of every language, as their folders list them; the order of lines decides the takes."""

    root = fresh_path(spark, "manifests")
    takes = views.takes(spark, d)
    lines = takes.select("lang", "sentence_id", "path", "ord")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(parts, "sentence_id").sortWithinPartitions("lang", "sentence_id", "ord").drop(
        "ord"
    ).write.partitionBy("lang").csv(root, sep="\t")
    folders = spark.read.schema("sentence_id string, path string, lang string").csv(root, sep="\t")
    languages = sorted(row["lang"] for row in folders.select("lang").distinct().collect())
    scanned = [readers.scan_takes(spark, f"{root}/lang={lang}", lang) for lang in languages]
    return pairing.first_last_take(reduce(DataFrame.unionByName, scanned))


def scan_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs written as files and scanned with their fixed schema."""

    path = fresh_path(spark, "pairs")
    views.pairs(spark, d).select(
        F.col("vec_id").cast("string").alias("clip_id"), F.lit(0).alias("frame"), "grp", "x", "y"
    ).write.parquet(path)
    return readers.scan_pairs(spark, path).groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.sum(V.total(F.col("x")))).alias("sum_x"),
        r6(F.sum(V.total(F.col("y")))).alias("sum_y"),
    )


def scan_debug_blocks(spark: SparkSession, d: str) -> DataFrame:
    """One log file per utterance; every fifth run printed no block."""

    root = fresh_path(spark, "logs")
    silent = F.when(F.col("utt") % 5 == 0, F.lit("run 1\nended early")).otherwise(F.col("text"))
    _log_texts(spark, d).select("utt", silent.alias("text")).repartition("utt").write.partitionBy("utt").text(root)
    blocks = readers.scan_debug_blocks(spark, root)
    return blocks.select(
        F.regexp_extract("path", r"/utt=(\d+)/", 1).cast("bigint").alias("utt"), "block.frames", "block.width"
    )


def scan_configs(spark: SparkSession, d: str) -> DataFrame:
    """Configurations written one per line and scanned from the files."""

    path = fresh_path(spark, "configs")
    views.config_texts(spark, d).select("text").write.text(path)
    return readers.scan_configs(spark, path, multiline=False).select("ckpt", "encoder_config.num_hidden_layers")


def nonempty(spark: SparkSession, d: str) -> DataFrame:
    kept = sampling.require_nonempty(views.recordings(spark, d), "no recordings")
    return kept.agg(F.count(F.lit(1)).alias("n"))


def takes_first_last(spark: SparkSession, d: str) -> DataFrame:
    return pairing.first_last_take(views.takes(spark, d))


def shared_sentences(spark: SparkSession, d: str) -> DataFrame:
    takes = views.takes(spark, d)
    shared = pairing.shared_keys(
        takes.filter("lang = 'user'"), takes.filter("lang = 'assistant'"), "sentence_id"
    )
    return stable_order(shared, "sentence_id")


def existing_takes(spark: SparkSession, d: str) -> DataFrame:
    recorded = read_table(spark, d, "conversations").filter(F.length("text") >= 200)
    files = recorded.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".wav")).alias("path")
    )
    return pairing.existing_only(views.takes(spark, d), files).select("lang", "sentence_id", "path")


def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    pooled = retrieval.mean_pool(views.utterances(spark, d), ["lang", "utt"], ["x"], views.WIDTH)
    cells = pooled.select("lang", "utt", F.posexplode("x").alias("i", "v"))
    return _r(_long(cells, "i"), "v")


def centered_vectors(spark: SparkSession, d: str) -> DataFrame:
    pooled = retrieval.mean_pool(views.utterances(spark, d), ["lang", "utt"], ["y"], views.WIDTH)
    scaled = retrieval.center_and_normalize(pooled, ["lang"], ["y"], views.WIDTH)
    cells = scaled.select("lang", "utt", F.posexplode("y").alias("i", "v"))
    return _r(_long(cells, "i"), "v")


def pooled_projection(spark: SparkSession, d: str) -> DataFrame:
    """Project after pooling; the affine projection commutes with the mean."""

    pooled = retrieval.mean_pool(views.utterances(spark, d), ["lang", "utt"], ["x"], views.WIDTH)
    p, pb = views.projection_matrix()
    lifted = scoring.project(pooled, p, pb)
    out = lifted.select("lang", "utt", V.total(F.col("x")).alias("total"), V.norm(F.col("x")).alias("length"))
    return _r(out, "total", "length")


def truth_ranks(spark: SparkSession, d: str) -> DataFrame:
    sets = crosslingual.probe_sets(views.utterances(spark, d), views.WIDTH)
    return crosslingual.ranks(sets, views.WIDTH)


def retrieval_table(spark: SparkSession, d: str) -> DataFrame:
    out = crosslingual.retrieval_table(views.utterances(spark, d), views.WIDTH)
    return _r(out, "top1", "top5", "median_rank", "chance_top1")


def takes_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns against user turns of the same conversation, three frames per turn."""

    takes = views.takes(spark, d)
    pairs = views.pairs(spark, d)
    backward = fits.ridge_map(fits.collect_moments(mom.moments(pairs, x="y", y="x"))[None], 0.01)
    projection = views.projection_matrix()
    aligned = backward.fold_into_projection(*projection)
    return _r(
        crosslingual.takes_retrieval(
            takes, takes.select("path"), views.take_frames(spark, d), "user", projection, aligned
        ),
        "top1", "top5", "median_rank", "chance_top1",
    )


# ------------------------------------------------------------ unit matching


def _whole(spark: SparkSession, d: str) -> DataFrame:
    return views.pairs(spark, d).withColumn("group", F.lit("residual"))


def _cost(spark: SparkSession, d: str) -> DataFrame:
    return matching.unit_cost(materialize(mom.moments(_whole(spark, d), ["group"])), "correlation", ["group"])


def unit_cost(spark: SparkSession, d: str) -> DataFrame:
    return _r(_long(_cost(spark, d), "src", "tgt"), "cost")


def unit_cost_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Cosine cost per group over rows scaled per batch."""

    pairs = views.pairs(spark, d).withColumn("batch_id", F.floor(F.col("vec_id") / 50))
    scaled = matching.rms_normalize(pairs, ["grp", "batch_id"])
    cost = matching.unit_cost(materialize(mom.moments(scaled, ["grp"])), "cosine", ["grp"])
    return _r(_long(cost, "src", "tgt"), "cost")


def unit_match(spark: SparkSession, d: str) -> DataFrame:
    plan = matching.integral_plan(_cost(spark, d), ["group"])
    return _r(_long(plan, "src", "tgt"), "mass").select("group", "src", "tgt", "mass")


def _ops(spark: SparkSession, d: str) -> DataFrame:
    return matching.operators_from_plan(matching.integral_plan(_cost(spark, d), ["group"]), ["group"])


def unit_sources(spark: SparkSession, d: str) -> DataFrame:
    ops = materialize(_ops(spark, d))
    best = matching.argmax_source(ops, ["group"])
    mass = matching.self_mass(ops, ["group"])
    return _r(_long(best.join(mass, ["group", "src"]), "src", "tgt"), "self_mass").select(
        "group", "tgt", "src", "self_mass"
    )


def match_summary(spark: SparkSession, d: str) -> DataFrame:
    return _r(
        alignment.transport_table(_whole(spark, d), ["group"]), "transport_cost", "identity_cost", "identity_agreement", "mean_self_mass", "min_self_mass"
    )


def match_by_group(spark: SparkSession, d: str) -> DataFrame:
    """One matching of four units per supplier group, solved in parallel, and what it costs."""

    cost = materialize(alignment.unit_costs(views.lineitem_pairs(spark, d), ["grp"]))
    plan = materialize(matching.integral_plan(cost, ["grp"]))
    summary = matching.match_summary(cost, plan, ["grp"]).select("grp", "transport_cost")
    out = plan.select("grp", "src", "tgt").join(summary, "grp")
    return _r(_long(out, "src", "tgt"), "transport_cost")


def auction_match(spark: SparkSession, d: str) -> DataFrame:
    """The matching of ``unit_match`` by bidding over short lists."""

    plan = auction.auction_plan(_cost(spark, d), ["group"])
    return _r(_long(plan, "src", "tgt"), "mass").select("group", "src", "tgt", "mass")


def auction_by_group(spark: SparkSession, d: str) -> DataFrame:
    """The matching of ``match_by_group`` by bidding, all groups at once, and what it costs."""

    cost = materialize(alignment.unit_costs(views.lineitem_pairs(spark, d), ["grp"]))
    plan = materialize(auction.auction_plan(cost, ["grp"]))
    summary = matching.match_summary(cost, plan, ["grp"]).select("grp", "transport_cost")
    return _r(_long(plan.select("grp", "src", "tgt").join(summary, "grp"), "src", "tgt"), "transport_cost")


def barycentric_match(spark: SparkSession, d: str) -> DataFrame:
    """Four source units against two target units per supplier group, mass shared and in one piece."""

    cost = materialize(alignment.unit_costs(views.lineitem_pairs(spark, d), ["grp"]).filter("tgt < 2"))
    paid = lambda plan, name: matching.match_summary(cost, plan, ["grp"]).select(
        "grp", F.col("transport_cost").alias(name)
    )
    shared = paid(materialize(matching.barycentric_plan(cost, ["grp"])), "barycentric_cost")
    whole = paid(materialize(matching.integral_plan(cost, ["grp"])), "integral_cost")
    return _r(shared.join(whole, "grp"), "barycentric_cost", "integral_cost")


def identity_ops(spark: SparkSession, d: str) -> DataFrame:
    """Groups without a plan keep their order: a change of basis by the identity changes nothing."""

    turned = tensors.turn_values(_base(spark, d), matching.identity_ops(spark, views.WIDTH), "synthesis")
    return _r(_long(tensors.tensor_cells(turned), "i"), "v")


def expand_ops(spark: SparkSession, d: str) -> DataFrame:
    spread = matching.expand_ops(_ops(spark, d), 2)
    return _r(_long(spread, "src", "tgt"), "analysis", "synthesis").select("src", "tgt", "analysis", "synthesis")


def concat_ops(spark: SparkSession, d: str) -> DataFrame:
    ops = materialize(_ops(spark, d))
    both = matching.concat_ops([(ops, 64, 64), (matching.expand_ops(ops, 2), 128, 128)])
    return _r(_long(both, "src", "tgt"), "analysis").select("src", "tgt", "analysis")


def project_axis(spark: SparkSession, d: str) -> DataFrame:
    turned = tensors.turn_values(_base(spark, d), materialize(_ops(spark, d)), "analysis")
    return _r(_long(tensors.tensor_cells(turned), "i"), "v")


def _block_weight() -> np.ndarray:
    rows, columns = np.meshgrid(np.arange(64), np.arange(64), indexing="ij")
    return ((rows * 13 + columns * 7) % 61 - 30) / 240.0


def block_contributions(spark: SparkSession, d: str) -> DataFrame:
    parts = matching.block_contributions(views.pairs(spark, d), ["vec_id"], _block_weight(), BLOCKS)
    out = parts.select(
        "vec_id", F.col("block").cast("bigint").alias("block"),
        V.total(F.col("v")).alias("total"), V.squared_norm(F.col("v")).alias("energy"),
    )
    return _r(out, "total", "energy")


def block_cost(spark: SparkSession, d: str) -> DataFrame:
    """Which block of one side adds what a block of the other adds, in the matched basis."""

    sources = np.array(alignment.matched_sources(fits.collect_moments(mom.moments(views.pairs(spark, d)))[None]))
    basis = np.zeros((64, 64))
    basis[sources, np.arange(64)] = 1.0
    weight = _block_weight()
    table = matching.block_unit_moments(views.pairs(spark, d), weight, weight, BLOCKS, basis)
    return _r(_long(matching.unit_cost(table), "src", "tgt"), "cost")


# ------------------------------------------------------------ signals


def preemphasis(spark: SparkSession, d: str) -> DataFrame:
    return _r(signals.preemphasis(views.signals(spark, d)), "v")


def causal_fir(spark: SparkSession, d: str) -> DataFrame:
    return _r(signals.causal_fir(views.signals(spark, d), FIR_KERNEL), "v")


def left_context(spark: SparkSession, d: str) -> DataFrame:
    return _r(signals.left_context(views.signals(spark, d), LEFT), "v")


def band_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairing.band_counts(views.signals(spark, d), "clip", "t", LEFT)


def band_sums(spark: SparkSession, d: str) -> DataFrame:
    frames = views.signals(spark, d)
    pairs = pairing.band_join(frames.select("clip", "t"), frames, "clip", "t", LEFT)
    out = pairs.groupBy("clip", "q").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("v").alias("total"))
    return _r(out, "total")


def frames(spark: SparkSession, d: str) -> DataFrame:
    framed = signals.frame_signal(views.signals(spark, d), SMALL_FFT, SMALL_WINDOW, SMALL_HOP)
    return _long(framed.select("clip", "frame", F.posexplode("samples").alias("pos", "v")), "pos")


def _window() -> np.ndarray:
    return (np.arange(SMALL_WINDOW) + 1.0) / SMALL_WINDOW


def _filters() -> np.ndarray:
    rows, bins = np.meshgrid(np.arange(SMALL_MELS), np.arange(SMALL_FFT // 2 + 1), indexing="ij")
    return ((rows + 1) * (bins + 1) % 5) / 4.0


def power_spectrum(spark: SparkSession, d: str) -> DataFrame:
    framed = signals.frame_signal(views.signals(spark, d), SMALL_FFT, SMALL_WINDOW, SMALL_HOP)
    power = signals.power_spectrum(framed, _window())
    cells = power.select("clip", "frame", F.posexplode("power").alias("bin", "v"))
    # the modulus: squares of these inputs fall on rounding boundaries
    return _r(_long(cells, "bin").withColumn("v", F.sqrt("v")), "v")


def _log_mel(spark: SparkSession, d: str) -> DataFrame:
    return signals.log_mel(views.signals(spark, d), _filters(), _window(), SMALL_FFT, SMALL_HOP)


def _bins(mel: DataFrame) -> DataFrame:
    return _long(mel.select("clip", "frame", F.posexplode("mel").alias("bin", "v")), "bin")


def log_mel(spark: SparkSession, d: str) -> DataFrame:
    return _r(_bins(_log_mel(spark, d)), "v", digits=5)


def per_feature_norm(spark: SparkSession, d: str) -> DataFrame:
    mel = materialize(_log_mel(spark, d))
    return _r(_bins(signals.normalize_channels(mel, ["clip"], "mel")), "v", digits=5)


def frames_out(spark: SparkSession, d: str) -> DataFrame:
    return views.recordings(spark, d).select(
        "path",
        signals.mel_frame_count(F.col("n_samples")).alias("mel_frames"),
        signals.frames_out(F.col("n_samples")).alias("frames"),
    )


def harmonic_features(spark: SparkSession, d: str) -> DataFrame:
    """Features for each sequence length that occurs among the clips."""

    lengths = read_table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    offsets = signals.relative_offsets(lengths.select("n").distinct())
    features = signals.harmonic_features(offsets.select("offset").distinct(), 8)
    out = offsets.join(features, "offset").select("n", "row", F.col("k").cast("bigint").alias("k"), "v")
    return _r(out, "v")


# ------------------------------------------------------------ parity


def _utterance_frames(spark: SparkSession, d: str) -> DataFrame:
    return views.utterances(spark, d).select("utt", "frame", "x", "y")


def describe_blocks(spark: SparkSession, d: str) -> DataFrame:
    out = parity.describe_block(_utterance_frames(spark, d), ["utt"], "frame", "x")
    joined = lambda c: F.array_join(F.transform(c, lambda v: r6(v).cast("string")), " ")
    out = _r(out, "mean", "std", "min", "max", "sum")
    return out.select("utt", "width", "frames", "mean", "std", "min", "max", "sum",
                      r6(V.total(F.col("first"))).alias("first_sum"), r6(V.total(F.col("last"))).alias("last_sum"))


def _log_texts(spark: SparkSession, d: str) -> DataFrame:
    """What a run printed about each utterance: right for even ones, another vector for odd."""

    shown = _utterance_frames(spark, d).withColumn(
        "z", F.when(F.col("utt") % 2 == 0, F.col("x")).otherwise(F.col("y"))
    )
    described = parity.describe_block(shown, ["utt"], "frame", "z")
    return described.select("utt", F.concat(F.lit("run 1\n"), parity.format_block(described)).alias("text"))


def debug_block_parity(spark: SparkSession, d: str) -> DataFrame:
    mine = parity.describe_block(_utterance_frames(spark, d), ["utt"], "frame", "x")
    theirs = parity.parse_debug_block(_log_texts(spark, d))
    return _r(parity.parity(mine, theirs, ["utt"]), "delta", digits=4)


def parity_verdict(spark: SparkSession, d: str) -> DataFrame:
    mine = parity.describe_block(_utterance_frames(spark, d), ["utt"], "frame", "x")
    theirs = parity.parse_debug_block(_log_texts(spark, d))
    return _r(parity.parity_verdict(parity.parity(mine, theirs, ["utt"]), ["utt"]), "worst_delta", digits=4)


def parity_failures(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts where a third of the groups have no log and a third a log without a block."""

    mine = parity.describe_block(_utterance_frames(spark, d), ["utt"], "frame", "x")
    logs = _log_texts(spark, d).filter("utt % 3 <> 2")
    silent = F.when(F.col("utt") % 3 == 1, F.lit("run 1\nended early\n")).otherwise(F.col("text"))
    theirs = parity.parse_debug_block(logs.withColumn("text", silent))
    return _r(parity.parity_verdict(parity.parity(mine, theirs, ["utt"]), ["utt"]), "worst_delta", digits=4)


def vector_diff(spark: SparkSession, d: str) -> DataFrame:
    pairs = views.pairs(spark, d)
    out = parity.vector_diff(
        pairs.select("vec_id", "grp", F.col("x").alias("v")),
        pairs.select("vec_id", F.col("y").alias("v")), ["vec_id"], by=["grp"],
    )
    return _r(out, "mae", "max_error", "cosine")


# ------------------------------------------------------------ tensors


def _base(spark: SparkSession, d: str, ckpt: str = "base") -> DataFrame:
    return views.tensors(spark, d).filter(F.col("ckpt") == ckpt).drop("ckpt")


def weight_drift(spark: SparkSession, d: str) -> DataFrame:
    out = tensors.weight_drift(
        views.tensors(spark, d), [("base", "descendant"), ("base", "ancestor"), ("ancestor", "descendant")]
    )
    return _r(out, "cosine")


def layer_count(spark: SparkSession, d: str) -> DataFrame:
    return tensors.count_layers(views.tensor_catalog(spark, d))


def precision_classes(spark: SparkSession, d: str) -> DataFrame:
    return tensors.precision_class(views.tensor_catalog(spark, d)).select("ckpt", "name", "precision")


def role_counts(spark: SparkSession, d: str) -> DataFrame:
    return tensors.role_counts(tensors.precision_class(views.tensor_catalog(spark, d)))


def renamed(spark: SparkSession, d: str) -> DataFrame:
    canonical = tensors.to_canonical(tensors.select_tensors(views.tensor_catalog(spark, d), "encoder."))
    return canonical.select("ckpt", "name", "new_name")


def short_names(spark: SparkSession, d: str) -> DataFrame:
    canonical = tensors.to_canonical(views.tensor_catalog(spark, d)).select(
        "ckpt", F.col("new_name").alias("name")
    )
    return tensors.to_short(canonical).select("ckpt", "name", "new_name")


def missing_companions(spark: SparkSession, d: str) -> DataFrame:
    return tensors.missing_companions(views.tensor_catalog(spark, d))


def own_or_borrowed(spark: SparkSession, d: str) -> DataFrame:
    catalog = views.tensor_catalog(spark, d)
    donor = catalog.filter(F.col("name").isin(tensors.COMPANIONS)).groupBy("name").agg(F.max("rows").alias("rows"))
    return tensors.own_or_borrowed(catalog, donor)


def derived_config(spark: SparkSession, d: str) -> DataFrame:
    return tensors.derive_config(tensors.to_canonical(views.tensor_catalog(spark, d)).drop("name").withColumnRenamed("new_name", "name"))


def equal_widths(spark: SparkSession, d: str) -> DataFrame:
    source = readers.parse_configs(views.config_texts(spark, d))
    narrow = F.when(F.col("ckpt") % 4 == 0, 32).otherwise(F.col("encoder_config.hidden_size")).cast("bigint")
    target = source.withColumn("encoder_config", F.col("encoder_config").withField("hidden_size", narrow))
    return tensors.equal_widths(source, target)


def key_difference(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "lineitem").select(
        F.concat(F.lit("part."), F.col("l_partkey").cast("string"), F.lit(".l"), F.col("l_linenumber").cast("string")).alias("name"),
        "l_returnflag",
    )
    tables = {flag: lines.filter(F.col("l_returnflag") == flag) for flag in ("A", "N", "R")}
    return pairing.key_difference(tables, "name")


def config_registry(spark: SparkSession, d: str) -> DataFrame:
    configs = readers.parse_configs(views.config_texts(spark, d))
    c = lambda f: F.col(f"encoder_config.{f}").alias(f)
    return configs.select(
        "ckpt", c("num_hidden_layers"), c("hidden_size"), c("num_attention_heads"), c("subsampling_factor"),
        tensors.left_context_width(F.col("encoder_config.sliding_window")).alias("left_context"),
    )


def config_verdict(spark: SparkSession, d: str) -> DataFrame:
    configs = readers.parse_configs(views.config_texts(spark, d))
    return tensors.compatibility(configs).filter("reason is not null").select("ckpt", "reason")


def task_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    fused = tensors.task_arithmetic(
        _base(spark, d), _base(spark, d, "ancestor"), _base(spark, d, "descendant"), 0.5
    )
    return _r(_long(tensors.tensor_cells(fused), "i"), "v")


def interpolate(spark: SparkSession, d: str) -> DataFrame:
    mixed = tensors.interpolate(_base(spark, d), _base(spark, d, "descendant"), 0.25)
    return _r(_long(tensors.tensor_cells(mixed), "i"), "v")


def lambda_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Fused vectors per weight, and how well a refitted per-channel map reads each set."""

    swept = tensors.lambda_sweep(
        _base(spark, d), _base(spark, d, "ancestor"), _base(spark, d, "descendant"), LAMBDAS
    )
    target = _base(spark, d, "descendant").select("name", "row", F.col("values").alias("y"))
    halves = swept.withColumnRenamed("values", "x").join(
        sampling.group_holdout(target, "name"), ["name", "row"]
    )
    table = mom.moments(halves, ["lambda", "split"])
    out = alignment.ladder_from_moments(table, ["identity", "diagonal"], ["lambda"])
    return _r(out, "r2", digits=5).select("lambda", "map", "r2")


def _with_norms(spark: SparkSession, d: str) -> DataFrame:
    base = _base(spark, d)
    norm_name = F.regexp_replace("name", r"self_attn\.q_proj", "norm_out")
    norms = base.groupBy(norm_name.alias("name")).agg(F.min_by("values", "row").alias("values"))
    return base.withColumn("ndim", F.lit(2)).unionByName(
        norms.withColumn("row", F.lit(0).cast("bigint")).withColumn("ndim", F.lit(1))
    )


def rebase(spark: SparkSession, d: str) -> DataFrame:
    moved = tensors.rebase(_with_norms(spark, d), materialize(_ops(spark, d)))
    return _r(_long(tensors.tensor_cells(moved), "i"), "v")


def fused_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """Bring ancestor and descendant into the base's order, then add their difference."""

    ops = materialize(_ops(spark, d))
    moved = lambda ckpt: tensors.rebase(_base(spark, d, ckpt).withColumn("ndim", F.lit(2)), ops)
    fused = tensors.task_arithmetic(
        _base(spark, d), moved("ancestor"), moved("descendant"), 0.5
    )
    return _r(_long(tensors.tensor_cells(fused), "i"), "v")


def aligned_tensors(spark: SparkSession, d: str) -> DataFrame:
    """An aligned checkpoint after a write and a read: what is new in it against its source."""

    pairs = views.pairs(spark, d)
    name, projection, fit_rows = alignment.chosen_projection(pairs, views.projection_matrix())
    featurizer = spark.createDataFrame(
        [("fb", i, [float(v) for v in row]) for i, row in enumerate(_filters())]
        + [("window", 0, [float(v) for v in _window()])],
        "name string, row bigint, values array<double>",
    )
    source = _base(spark, d)
    report = {"source": "base", "map": name, "fit_frames": fit_rows}
    out = fresh_path(spark, "aligned")
    writers.write_tensors(tensors.aligned_tensors(spark, source, projection, featurizer, report, "aligned"), out)
    read = readers.scan_tensors(spark, out, "aligned")
    counted = read.groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"))
    known = source.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    return counted.join(known, "name", "left").select("name", "n_rows", F.col("_n").isNull().alias("added"))


def tensor_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    out = fresh_path(spark, "tensors")
    writers.write_tensors(views.tensors(spark, d), out)
    read = readers.scan_tensors(spark, out, "descendant")
    total = read.select("name", "row", V.total(F.col("values")).alias("total"))
    return _r(total, "total")


def report_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Write the nested report, read it back and list its ladder."""

    pairs = views.pairs(spark, d)
    rungs = alignment.score_maps(pairs, ["identity", "diagonal"]).withColumn("shippable", F.lit(True))
    # a report without a chosen map reads back as "?"
    header = pairs.agg(F.count(F.lit(1)).alias("fit_frames"))
    out = fresh_path(spark, "report")
    writers.write_report(
        writers.build_report(header, rungs, alignment.transport_table(_whole(spark, d), ["group"])), out
    )
    read = readers.scan_report(spark, out)
    listed = read.select(
        F.col("map").alias("chosen"), "fit_frames", F.size("transport").cast("bigint").alias("n_groups"), F.inline("ladder")
    )
    return _r(listed, "r2", "cosine_mean").select("chosen", "fit_frames", "n_groups", "map", "r2", "cosine_mean")


def report_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The sweep behind the ridge rung and the details of the run, after a write and a read."""

    pairs = views.pairs(spark, d)
    sweep = materialize(alignment.ridge_sweep(pairs).withColumn("map", F.lit("ridge")))
    best = sweep.filter("is_best").select("map", "alpha", "r2", F.lit(1).alias("ord"))
    detail = best.select(F.struct("alpha").alias("detail"))
    header = pairs.agg(F.count(F.lit(1)).alias("clips")).select(
        F.lit("ridge").alias("map"), "clips", F.lit(0.4).alias("seconds"),
        F.lit("correlation").alias("ground_metric"), F.lit(False).alias("source_normalize"),
    ).crossJoin(F.broadcast(detail))
    out = fresh_path(spark, "report")
    writers.write_report(writers.build_report(header, alignment.with_sweep(best, sweep)), out)
    read = readers.scan_report(spark, out)
    rung = read.withColumn("rung", F.element_at("ladder", 1))
    listed = rung.select(
        F.col("map").alias("chosen"), "clips", "seconds", "ground_metric", "source_normalize",
        F.col("detail.alpha").alias("best_alpha"), F.inline("rung.sweep"),
    )
    return _r(
        listed.select("chosen", "clips", "seconds", "ground_metric", "source_normalize", "best_alpha", "alpha", "r2", "cosine_p05"),
        "r2", "cosine_p05",
    )


def probe_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    table = crosslingual.retrieval_table(views.utterances(spark, d), views.WIDTH)
    out = fresh_path(spark, "probes")
    writers.write_probe_table(table.withColumn("language", F.col("language").cast("string")), out)
    return _r(readers.scan_probe_table(spark, out), "top1", "top5", "median_rank", "chance_top1")


def mlp_scores(spark: SparkSession, d: str) -> DataFrame:
    w1, b1 = _grid(32, 64, 5, 3, 37), np.arange(32) / 64.0
    w2, b2 = _grid(16, 32, 7, 11, 29), np.arange(16) / 32.0
    out = scoring.mlp_scores(views.pairs(spark, d).select("vec_id", "x"), w1, b1, w2, b2, "x", "z")
    cells = out.select("vec_id", F.posexplode("z").alias("j", "v"))
    return _r(_long(cells, "j"), "v")


# ------------------------------------------------------------ streaming


def _pair_files(spark: SparkSession, pairs: DataFrame, parts: int) -> str:
    """At least ``parts`` files of at most ``FILE_ROWS`` pairs, written by the tasks that read them."""

    out = fresh_path(spark, "pairs")
    limit = min(FILE_ROWS, max(1, -(-pairs.count() // parts)))
    pairs.write.option("maxRecordsPerFile", limit).parquet(out)
    return out


def _line_stream(spark: SparkSession, d: str) -> DataFrame:
    """The line items of the given table as a stream of its files, as pairs."""

    schema = read_table(spark, d, "lineitem").schema
    # a pattern, as the table may be one file or a folder of files
    return views.pairs_of_lines(statistics.read_pair_stream(spark, f"{d}/lineitem.parque[t]", schema, 1))


def stream_moments(spark: SparkSession, d: str) -> DataFrame:
    """Line-item pairs as a stream; merged micro-batch partials."""

    out = fresh_path(spark, "partials")
    query = statistics.write_partial_moments(
        _line_stream(spark, d), out, fresh_path(spark, "offsets"), full_yy=True, widths=(4, 4)
    )
    query.awaitTermination()
    return _r(_long(statistics.merged_partials(spark, out), "i", "j"), "v", digits=4)


def stream_state_moments(spark: SparkSession, d: str) -> DataFrame:
    """The same sums kept in the state store: one row per cell, whatever the number of pairs."""

    name = f"cells_{uuid.uuid4().hex}"
    query = (
        statistics.stream_moments(_line_stream(spark, d))
        .writeStream.format("memory")
        .queryName(name)
        .outputMode("complete")
        .option("checkpointLocation", fresh_path(spark, "offsets"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return _r(_long(spark.table(name), "i", "j"), "v", digits=4)


def stream_unit_stats(spark: SparkSession, d: str) -> DataFrame:
    """Unit costs from a stream whose rows are scaled per batch inside each micro-batch."""

    pairs = views.pairs(spark, d).select(
        F.floor(F.col("vec_id") / 50).alias("batch_id"), "x", "y"
    )
    out_files = fresh_path(spark, "pairs")
    # one batch is never split over files; their number follows the rows
    pairs.repartition(max(4, -(-pairs.count() // FILE_ROWS)), "batch_id").write.parquet(out_files)
    stream = statistics.read_pair_stream(spark, out_files, pairs.schema, 1)
    out = fresh_path(spark, "partials")
    statistics.write_partial_moments(
        stream, out, fresh_path(spark, "offsets"), rms_keys=["batch_id"]
    ).awaitTermination()
    cost = matching.unit_cost(statistics.merged_partials(spark, out))
    return _r(_long(cost, "src", "tgt"), "cost")


def stream_cap(spark: SparkSession, d: str) -> DataFrame:
    """Stop reading once the cap is reached; the cap is the feature."""

    pairs = views.lineitem_pairs(spark, d)
    files = _pair_files(spark, pairs, 6)
    stream = statistics.read_pair_stream(spark, files, pairs.schema, 1)
    out = fresh_path(spark, "capped")
    statistics.write_capped(stream, out, fresh_path(spark, "offsets"), 1500)
    kept = statistics.capped_rows(spark, out, 1500, ["grp"])
    return sampling.frame_count(kept)


QUERIES = {
    "pairs_checksum": pairs_checksum,
    "recording_sample": recording_sample,
    "recording_groups": recording_groups,
    "holdout_counts": holdout_counts,
    "crop_text": crop_text,
    "batch_sizes": batch_sizes,
    "capped_rows": capped_rows,
    "frame_units": frame_units,
    "rate_quarantine": rate_quarantine,
    "downmix": downmix,
    "hook_groups": hook_groups,
    "moments_long": moments_long,
    "merged_moments": merged_moments,
    "moments_wide": moments_wide,
    "covariance": covariance,
    "diagonal_score": diagonal_score,
    "identity_score": identity_score,
    "permutation_score": permutation_score,
    "orthogonal_score": orthogonal_score,
    "ridge_score": ridge_score,
    "ridge_sweep": ridge_sweep,
    "ridge_by_group": ridge_by_group,
    "map_weights": map_weights,
    "procrustes_orthogonality": procrustes_orthogonality,
    "score_from_moments": score_from_moments,
    "group_ladder": group_ladder,
    "ladder": ladder,
    "ladder_with_head": ladder_with_head,
    "best_map": best_map,
    "deployed_score": deployed_score,
    "report_lines": report_lines,
    "normalisation_what_if": normalisation_what_if,
    "q8_codes": q8_codes,
    "q8_loss": q8_loss,
    "f16_round": f16_round,
    "deployed_tensors": deployed_tensors,
    "sql_functions": sql_functions,
    "takes_first_last": takes_first_last,
    "shared_sentences": shared_sentences,
    "existing_takes": existing_takes,
    "mean_pool": mean_pool,
    "centered_vectors": centered_vectors,
    "pooled_projection": pooled_projection,
    "truth_ranks": truth_ranks,
    "retrieval": retrieval_table,
    "takes_retrieval": takes_retrieval,
    "unit_cost": unit_cost,
    "unit_cost_by_group": unit_cost_by_group,
    "unit_match": unit_match,
    "unit_sources": unit_sources,
    "match_summary": match_summary,
    "match_by_group": match_by_group,
    "auction_match": auction_match,
    "auction_by_group": auction_by_group,
    "barycentric_match": barycentric_match,
    "expand_ops": expand_ops,
    "concat_ops": concat_ops,
    "project_axis": project_axis,
    "block_contributions": block_contributions,
    "block_cost": block_cost,
    "preemphasis": preemphasis,
    "causal_fir": causal_fir,
    "left_context": left_context,
    "band_pairs": band_pairs,
    "band_sums": band_sums,
    "frames": frames,
    "power_spectrum": power_spectrum,
    "log_mel": log_mel,
    "per_feature_norm": per_feature_norm,
    "frames_out": frames_out,
    "harmonic_features": harmonic_features,
    "describe_blocks": describe_blocks,
    "debug_block_parity": debug_block_parity,
    "parity_verdict": parity_verdict,
    "vector_diff": vector_diff,
    "parity_failures": parity_failures,
    "scan_recordings": scan_recordings,
    "scan_takes": scan_takes,
    "scan_pairs": scan_pairs,
    "scan_debug_blocks": scan_debug_blocks,
    "scan_configs": scan_configs,
    "nonempty": nonempty,
    "identity_ops": identity_ops,
    "weight_drift": weight_drift,
    "layer_count": layer_count,
    "precision_classes": precision_classes,
    "role_counts": role_counts,
    "renamed": renamed,
    "short_names": short_names,
    "missing_companions": missing_companions,
    "own_or_borrowed": own_or_borrowed,
    "derived_config": derived_config,
    "key_difference": key_difference,
    "config_registry": config_registry,
    "config_verdict": config_verdict,
    "task_arithmetic": task_arithmetic,
    "interpolate": interpolate,
    "lambda_sweep": lambda_sweep,
    "rebase": rebase,
    "fused_checkpoint": fused_checkpoint,
    "aligned_tensors": aligned_tensors,
    "tensor_roundtrip": tensor_roundtrip,
    "report_roundtrip": report_roundtrip,
    "probe_roundtrip": probe_roundtrip,
    "report_sweep": report_sweep,
    "mlp_scores": mlp_scores,
    "stream_moments": stream_moments,
    "stream_state_moments": stream_state_moments,
    "equal_widths": equal_widths,
    "stream_unit_stats": stream_unit_stats,
    "stream_cap": stream_cap,
}
