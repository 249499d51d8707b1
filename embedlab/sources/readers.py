"""Scans with fixed schemas. Nothing is inferred and nothing is read that is not asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedlab.operators.parity import parse_debug_block
from embedlab.operators.sampling import require_nonempty

PAIR_SCHEMA = "clip_id string, frame int, grp string, x array<double>, y array<double>"
TENSOR_SCHEMA = "name string, row bigint, values array<double>, ckpt string"
ENCODER_CONFIG = (
    "struct<num_hidden_layers: bigint, hidden_size: bigint, num_attention_heads: bigint, "
    "intermediate_size: bigint, num_mel_bins: bigint, subsampling_factor: bigint, "
    "conv_kernel_size: bigint, sliding_window: bigint, attention_bias: boolean, "
    "convolution_bias: boolean, scale_input: boolean>"
)
CONFIG_SCHEMA = f"ckpt bigint, model_type string, encoder_config {ENCODER_CONFIG}"
SCORE_FIELDS = (
    "map: string, r2: double, relative_error: double, cosine_mean: double, cosine_p05: double, "
    "deployed_r2: double, deployed_cosine_mean: double, alpha: double, scale: double, "
    "explained_singular_mass: double, shippable: boolean, "
    "sweep: array<struct<alpha: double, r2: double, relative_error: double, cosine_mean: double, "
    "cosine_p05: double, deployed_r2: double>>"
)
TRANSPORT_FIELDS = (
    "group: string, source_size: bigint, target_size: bigint, transport_cost: double, "
    "identity_cost: double, identity_agreement: double, mean_self_mass: double, "
    "min_self_mass: double"
)
REPORT_SCHEMA = (
    "map string, projection_dim bigint, detail struct<alpha: double, scale: double, "
    "explained_singular_mass: double>, source string, container string, audio string, clips bigint, "
    "seconds double, fit_frames bigint, eval_frames bigint, source_normalize boolean, "
    "ground_metric string, column_assignment string, "
    f"ladder array<struct<{SCORE_FIELDS}>>, transport array<struct<{TRANSPORT_FIELDS}>>"
)
PROBE_SCHEMA = (
    "language string, probe string, n bigint, top1 double, top5 double, median_rank double, "
    "chance_top1 double"
)


def scan_recordings(spark: SparkSession, root: str, pattern: str = "*.flac") -> DataFrame:
    """Recursive listing, path and length only: file contents are not read."""

    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", "length")
    )
    return require_nonempty(listing, f"no file matching {pattern} under {root}")


def scan_takes(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """Manifest rows with ``ord``, which sorts like the lines of the file.

    Spark rows have no order of their own; file, split offset and the running number inside a
    split put it back.
    """

    raw = spark.read.schema("sentence_id string, file string").csv(path, sep="\t", header=False)
    return raw.select(
        F.lit(lang).alias("lang"),
        "sentence_id",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("ord"),
        F.col("file").alias("path"),
    )


def scan_pairs(spark: SparkSession, path: str, schema: str = PAIR_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def scan_debug_blocks(spark: SparkSession, path: str, **sentinels: str) -> DataFrame:
    """One row per log file with its parsed block."""

    logs = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_path").alias("path"),
        F.col("value").alias("text"),
    )
    return parse_debug_block(logs, **sentinels)


def parse_configs(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.select(F.from_json(text, CONFIG_SCHEMA).alias("c")).select("c.*")


def scan_configs(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    return spark.read.schema(CONFIG_SCHEMA).json(path, multiLine=multiline)


def scan_report(spark: SparkSession, path: str) -> DataFrame:
    """Reports; one without a chosen map shows ``?``."""

    return spark.read.schema(REPORT_SCHEMA).json(path).withColumn(
        "map", F.coalesce("map", F.lit("?"))
    )


def scan_probe_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROBE_SCHEMA).json(path)


def scan_tensors(
    spark: SparkSession, path: str, ckpt: str | None = None, names: list[str] | None = None
) -> DataFrame:
    """Tensors by checkpoint (partition pruning) and name (row-group pruning)."""

    out = spark.read.schema(TENSOR_SCHEMA).parquet(path)
    if ckpt is not None:
        out = out.filter(F.col("ckpt") == ckpt)
    if names is not None:
        out = out.filter(F.col("name").isin(names))
    return out
