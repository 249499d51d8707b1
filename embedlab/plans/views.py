"""Input views: how the given tables stand in for pairs, recordings, signals and tensors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedlab.functions import vectors as V
from embedlab.operators.ordering import dense_positions
from embedlab.sources.tables import read_table

WIDTH = 64
RATE = 1000
CROP = 400


def _targets() -> str:
    """All 64 target units as one SQL array: parsed once instead of built call by call."""

    terms = []
    for j in range(WIDTH):
        wobble = f"(pmod(vec_id * 31 + {j * 17}, 97) - 48) / 48D"
        terms.append(
            f"{0.8 * (1 + 0.01 * j)!r}D * x[{(j + 1) % WIDTH}] + 0.1D * x[{j}]"
            f" + 0.002D * ({wobble}) + {0.01 * j!r}D"
        )
    return f"array({', '.join(terms)})"


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``(vec_id, grp, x, y)``: a known shift, gain, offset, leakage and small noise."""

    base = read_table(spark, folder, "embeddings").select(
        "vec_id", F.col("label").cast("string").alias("grp"), V.as_doubles(F.col("embedding")).alias("x")
    )
    return base.withColumn("y", F.expr(_targets()))


def lineitem_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``(grp, x, y)`` at width 4, one row per line item; the last target is not linear."""

    return pairs_of_lines(read_table(spark, folder, "lineitem"))


def pairs_of_lines(lines: DataFrame) -> DataFrame:
    """The same from a table or a stream of line items."""

    raw = lines.select(
        (F.col("l_suppkey") % 20).cast("string").alias("grp"),
        (F.col("l_quantity") / 50.0).alias("x0"),
        (F.col("l_extendedprice") / 100000.0).alias("x1"),
        (F.col("l_discount") * 10.0).alias("x2"),
        (F.col("l_tax") * 10.0).alias("x3"),
    )
    x0, x1, x2, x3 = (F.col(f"x{i}") for i in range(4))
    return raw.select(
        "grp",
        F.array(x0, x1, x2, x3).alias("x"),
        F.array(
            0.9 * x0 + 0.2 * x2,
            1.1 * x1 - 0.1 * x3 + 0.05,
            x3 - 0.3 * x0,
            0.5 * x2 + 0.25 * x1 * x0,
        ).alias("y"),
    )


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, n_samples, rate)`` per document, path ``source/lang/id.flac``."""

    return read_table(spark, folder, "documents").select(
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".flac"))).alias("path"),
        F.col("n_chars").alias("n_samples"),
        F.lit(RATE).alias("rate"),
    )


def takes(spark: SparkSession, folder: str) -> DataFrame:
    """``(lang, sentence_id, ord, path)`` per conversation turn."""

    return read_table(spark, folder, "conversations").select(
        F.col("role").alias("lang"),
        F.col("conv_id").alias("sentence_id"),
        F.col("turn").alias("ord"),
        F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".wav")).alias("path"),
    )


def take_frames(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, frame, x, y)``: three vectors per take, near copies for takes of one sentence."""

    vectors = pairs(spark, folder).select("vec_id", "x", "y")
    total = read_table(spark, folder, "embeddings").count()
    spread = takes(spark, folder).withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(2))))
    pick = (F.col("sentence_id") * 5 + F.col("frame") * 3 + F.col("ord") % 2) % total
    return spread.withColumn("vec_id", pick).join(vectors, "vec_id").select("path", "frame", "x", "y")


def utterances(spark: SparkSession, folder: str) -> DataFrame:
    """``(utt, lang, frame, x, y)``: four frames per utterance, three languages."""

    utt = F.floor(F.col("vec_id") / 4)
    return pairs(spark, folder).select(
        utt.alias("utt"), (utt % 3).alias("lang"), (F.col("vec_id") % 4).alias("frame"), "x", "y"
    )


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """``(clip, t, v)``: events of one user in time order."""

    events = read_table(spark, folder, "events").select("user_id", "ts", "event_id", "value")
    placed = dense_positions(events, ["user_id"], ["ts", "event_id"], "t")
    return placed.select(F.col("user_id").alias("clip"), "t", F.col("value").alias("v"))


def stereo(spark: SparkSession, folder: str) -> DataFrame:
    """``(clip, t, channel, v)``: each event as two channels, ``t`` its event id."""

    events = read_table(spark, folder, "events")
    both = F.array(
        F.struct(F.lit(0).alias("channel"), F.col("value").alias("v")),
        F.struct(F.lit(1).alias("channel"), (F.col("value") * 0.5 + 1.0).alias("v")),
    )
    return events.select(F.col("user_id").alias("clip"), F.col("event_id").alias("t"), F.inline(both))


def tensors(spark: SparkSession, folder: str) -> DataFrame:
    """``(ckpt, name, row, values)``: three checkpoints with the same tensors.

    Rows are keyed by ``vec_id`` inside a tensor, which is enough for keyed arithmetic.
    """

    each = F.array(
        F.struct(F.lit("base").alias("ckpt"), F.col("x").alias("values")),
        F.struct(F.lit("descendant").alias("ckpt"), F.col("y").alias("values")),
        F.struct(F.lit("ancestor").alias("ckpt"), V.scale(F.col("x"), F.lit(0.5)).alias("values")),
    )
    name = F.concat(F.lit("encoder.layers."), F.col("grp"), F.lit(".self_attn.q_proj.weight"))
    return pairs(spark, folder).select(name.alias("name"), F.col("vec_id").alias("row"), F.inline(each)).select(
        "ckpt", "name", "row", "values"
    )


# Tensor name endings used to build a catalogue out of line items.
CATALOG_SUFFIXES = [
    "self_attn.q_proj.weight",
    "self_attn.linear_k.weight",
    "self_attn.bias_u",
    "norm_out.weight",
    "feed_forward1.linear1.weight",
    "conv.pointwise_conv1.weight",
    "conv.depthwise_conv.weight",
    "conv.batch_norm.weight",
]
# Checkpoint-level tensors, present or not by line item.
CATALOG_TOP = [
    "proj.weight",
    "proj.bias",
    "preprocessor.featurizer.fb",
    "preprocessor.featurizer.window",
]


def tensor_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """``(ckpt, name, ndim, rows, width)``: one checkpoint per order, tensors from its lines."""

    suffixes = F.array(*[F.lit(s) for s in CATALOG_SUFFIXES])
    top = F.array(*[F.lit(s) for s in CATALOG_TOP])
    pick = (F.col("l_partkey") % 8).cast("int")
    layered = F.concat(
        F.lit("encoder.layers."), (F.col("l_linenumber") - 1).cast("string"), F.lit("."), suffixes[pick]
    )
    ckpt_level = top[(F.col("l_suppkey") % 4).cast("int")]
    name = F.when(F.col("l_partkey") % 5 == 0, ckpt_level).otherwise(layered)
    lines = read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("ckpt"),
        name.alias("name"),
        F.col("l_quantity").cast("bigint").alias("q"),
    )
    grouped = lines.groupBy("ckpt", "name").agg(F.max("q").alias("q"))
    flat = F.col("name").endswith("bias") | F.col("name").endswith("bias_u") | F.col("name").rlike(
        r"(norm|norm_out)\.weight$"
    )
    return grouped.select(
        "ckpt",
        "name",
        F.when(flat, F.lit(1)).otherwise(F.lit(2)).alias("ndim"),
        F.col("q").alias("rows"),
        (F.col("q") * 32).alias("width"),
    )

def config_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``(ckpt, text)``: one JSON configuration per part, some of them not compatible."""

    key = F.col("p_partkey")
    g = key % 10
    flag = lambda at: F.when(g != 8, g == at)  # noqa: E731  (absent when g = 8)
    body = F.struct(
        F.col("p_size").cast("bigint").alias("num_hidden_layers"),
        F.lit(64).cast("bigint").alias("hidden_size"),
        F.lit(8).cast("bigint").alias("num_attention_heads"),
        F.lit(256).cast("bigint").alias("intermediate_size"),
        F.lit(16).cast("bigint").alias("num_mel_bins"),
        F.when(g == 3, 4).otherwise(8).cast("bigint").alias("subsampling_factor"),
        F.lit(9).cast("bigint").alias("conv_kernel_size"),
        (F.lit(57) + key % 15).cast("bigint").alias("sliding_window"),
        flag(5).alias("attention_bias"),
        flag(6).alias("convolution_bias"),
        flag(7).alias("scale_input"),
    )
    return read_table(spark, folder, "part").select(
        key.alias("ckpt"), F.to_json(F.struct(key.alias("ckpt"), body.alias("encoder_config"))).alias("text")
    )


def projection_matrix(out: int = 96, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """A deterministic dense projection (out, in) and bias; a parameter, not data."""

    rows, columns = np.meshgrid(np.arange(out), np.arange(width), indexing="ij")
    return ((rows * 31 + columns * 17) % 97 - 48) / 384.0, np.arange(out) / 100.0
