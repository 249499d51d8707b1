"""Keyed arithmetic and audits over tables of tensors ``(ckpt, name, row, values)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embedlab.functions import quant
from embedlab.functions.vectors import scale
from embedlab.functions.text import has_any_suffix, layer_index, layer_suffix
from embedlab.operators.pairing import guarded_join, left_driven_join
from embedlab.session import BROADCAST_BYTES

# Fixed value: the tensor that every complete layer has.
LAYER_ANCHOR = ".norm_out.weight"
# Fixed value: mel bins of the container format.
MEL_BINS = 128

# Name endings by stored precision.
F16_SUFFIXES = [
    "encoder.subsampling.conv_in.weight",
    "encoder.subsampling.layers.0.depthwise_conv.weight",
    "encoder.subsampling.layers.0.pointwise_conv.weight",
    "encoder.subsampling.layers.1.depthwise_conv.weight",
    "encoder.subsampling.layers.1.pointwise_conv.weight",
    "conv.pointwise_conv1.weight",
    "conv.pointwise_conv2.weight",
]
Q8_SUFFIXES = [
    "encoder.subsampling.linear.weight",
    "self_attn.q_proj.weight",
    "self_attn.k_proj.weight",
    "self_attn.v_proj.weight",
    "self_attn.o_proj.weight",
    "self_attn.relative_k_proj.weight",
    "feed_forward1.linear1.weight",
    "feed_forward1.linear2.weight",
    "feed_forward2.linear1.weight",
    "feed_forward2.linear2.weight",
    "proj.weight",
]

# The two names of a tensor inside one layer; unlisted names are the same.
LAYER_NAMES = {
    "self_attn.linear_q.weight": "self_attn.q_proj.weight",
    "self_attn.linear_k.weight": "self_attn.k_proj.weight",
    "self_attn.linear_v.weight": "self_attn.v_proj.weight",
    "self_attn.linear_out.weight": "self_attn.o_proj.weight",
    "self_attn.linear_pos.weight": "self_attn.relative_k_proj.weight",
    "self_attn.pos_bias_u": "self_attn.bias_u",
    "self_attn.pos_bias_v": "self_attn.bias_v",
    "conv.batch_norm.weight": "conv.norm.weight",
    "conv.batch_norm.bias": "conv.norm.bias",
}
# Names outside the layers.
STEM_NAMES = {
    "encoder.pre_encode.conv.0": "encoder.subsampling.conv_in",
    "encoder.pre_encode.conv.2": "encoder.subsampling.layers.0.depthwise_conv",
    "encoder.pre_encode.conv.3": "encoder.subsampling.layers.0.pointwise_conv",
    "encoder.pre_encode.conv.5": "encoder.subsampling.layers.1.depthwise_conv",
    "encoder.pre_encode.conv.6": "encoder.subsampling.layers.1.pointwise_conv",
    "encoder.pre_encode.out": "encoder.subsampling.linear",
}
# The short naming, per layer under "a.blk.<n>." and outside the layers.
SHORT_LAYER_NAMES = {
    "self_attn.q_proj.weight": "attn_q.weight",
    "self_attn.k_proj.weight": "attn_k.weight",
    "self_attn.v_proj.weight": "attn_v.weight",
    "self_attn.o_proj.weight": "attn_out.weight",
    "self_attn.relative_k_proj.weight": "linear_pos.weight",
    "self_attn.bias_u": "pos_bias_u",
    "self_attn.bias_v": "pos_bias_v",
    "norm_self_att.weight": "ln1.weight",
    "norm_self_att.bias": "ln1.bias",
    "norm_out.weight": "ln2.weight",
    "norm_out.bias": "ln2.bias",
    "norm_feed_forward1.weight": "ffn_norm.weight",
    "norm_feed_forward1.bias": "ffn_norm.bias",
    "norm_feed_forward2.weight": "ffn_norm_1.weight",
    "norm_feed_forward2.bias": "ffn_norm_1.bias",
    "feed_forward1.linear1.weight": "ffn_up.weight",
    "feed_forward1.linear2.weight": "ffn_down.weight",
    "feed_forward2.linear1.weight": "ffn_up_1.weight",
    "feed_forward2.linear2.weight": "ffn_down_1.weight",
    "conv.pointwise_conv1.weight": "conv_pw1.weight",
    "conv.pointwise_conv2.weight": "conv_pw2.weight",
    "conv.depthwise_conv.weight": "conv_dw.weight",
    "conv.norm.weight": "conv_norm.weight",
    "conv.norm.bias": "conv_norm.bias",
}
SHORT_STEM_NAMES = {
    "encoder.subsampling.conv_in": "a.conv1d.0",
    "encoder.subsampling.layers.0.depthwise_conv": "a.conv1d.2",
    "encoder.subsampling.layers.0.pointwise_conv": "a.conv1d.3",
    "encoder.subsampling.layers.1.depthwise_conv": "a.conv1d.5",
    "encoder.subsampling.layers.1.pointwise_conv": "a.conv1d.6",
    "encoder.subsampling.linear": "a.pre_encode.out",
    "proj": "mm.a.proj",
}
SHORT_WHOLE_NAMES = {
    "preprocessor.featurizer.fb": "a.mel_filters",
    "preprocessor.featurizer.window": "a.window",
}

# What a self-contained checkpoint carries besides the encoder.
COMPANIONS = [
    "proj.weight",
    "proj.bias",
    "preprocessor.featurizer.fb",
    "preprocessor.featurizer.window",
]
LEFT_CONTEXT_WINDOW = 71
CELL_BYTES = 64
SUBSAMPLING = 8


# ---------------------------------------------------------------- names


def select_tensors(tensors: DataFrame, prefix: str, exclude: bool = False) -> DataFrame:
    kept = F.col("name").startswith(prefix)
    return tensors.filter(~kept if exclude else kept)


def precision_class(catalog: DataFrame) -> DataFrame:
    """Add ``precision``: f16 by suffix first, then q8_0 for 2-D, else f32.

    A q8_0 row whose width is no multiple of 32 fails the job.
    """

    wide = F.col("width") % quant.BLOCK != 0
    q8 = F.when(
        wide, F.raise_error(F.concat(F.lit("not whole blocks of 32: "), F.col("name")))
    ).otherwise(F.lit("q8_0"))
    return catalog.withColumn(
        "precision",
        F.when(has_any_suffix(F.col("name"), F16_SUFFIXES), F.lit("f16"))
        .when((F.col("ndim") == 2) & has_any_suffix(F.col("name"), Q8_SUFFIXES), q8)
        .otherwise(F.lit("f32")),
    )


def role_counts(classified: DataFrame) -> DataFrame:
    """How many tensors per checkpoint are quantised, half precision or dense."""

    one = lambda kind: F.sum((F.col("precision") == kind).cast("bigint"))
    return classified.groupBy("ckpt").agg(
        one("q8_0").alias("n_q8_0"), one("f16").alias("n_f16"), one("f32").alias("n_f32")
    )


def as_deployed(tensors: DataFrame) -> DataFrame:
    """Round a tensor table the way it will be stored: f16, q8_0 or untouched."""

    classified = precision_class(
        tensors.withColumn("width", F.size("values")) if "width" not in tensors.columns else tensors
    )
    values = (
        F.when(F.col("precision") == "f16", F.transform("values", quant.f16))
        .when(F.col("precision") == "q8_0", quant.q8_0(F.col("values")))
        .otherwise(F.col("values"))
    )
    return classified.withColumn("values", values).select(*tensors.columns)


def rename_tensors(
    catalog: DataFrame,
    layer_names: dict[str, str],
    stem_names: dict[str, str],
    layer_prefix: str = "encoder.layers.",
    whole_names: dict[str, str] | None = None,
) -> DataFrame:
    """Add ``new_name``. The layer number is carried over and unlisted names stay.

    The rules are constant maps inside the projection: no join and no shuffle.
    """

    def lookup(table: dict[str, str], key):
        entries = [F.lit(v) for pair in table.items() for v in pair]
        return F.try_element_at(F.create_map(*entries), key)

    name = F.col("name")
    suffix = layer_suffix(name)
    index = layer_index(name)
    in_layer = F.concat(
        F.lit(layer_prefix), index.cast("string"), F.lit("."),
        F.coalesce(lookup(layer_names, suffix), suffix),
    )
    module = F.regexp_replace(name, r"\.(weight|bias)$", "")
    tail = F.regexp_extract(name, r"(\.(?:weight|bias))$", 1)
    stem = F.concat(F.coalesce(lookup(stem_names, module), module), tail)
    if whole_names:
        stem = F.coalesce(lookup(whole_names, name), stem)
    return catalog.withColumn("new_name", F.when(index.isNotNull(), in_layer).otherwise(stem))


def to_canonical(catalog: DataFrame) -> DataFrame:
    return rename_tensors(catalog, LAYER_NAMES, STEM_NAMES)


def to_short(catalog: DataFrame) -> DataFrame:
    return rename_tensors(
        catalog, SHORT_LAYER_NAMES, SHORT_STEM_NAMES, "a.blk.", SHORT_WHOLE_NAMES
    )


def count_layers(catalog: DataFrame) -> DataFrame:
    """``(ckpt, n_layers)``: length of the run 0, 1, 2, ... of layers that have the anchor tensor.

    A checkpoint without layer 0 counts 0; ``require_layers`` makes that an error. The set of layer
    numbers per checkpoint is what is gathered, a handful of integers.
    """

    anchored = F.when(F.col("name").endswith(LAYER_ANCHOR), layer_index(F.col("name")))
    layers = catalog.select("ckpt", anchored.alias("layer")).distinct()
    gathered = layers.groupBy("ckpt").agg(F.sort_array(F.collect_list("layer")).alias("_l"))
    run = F.size(
        F.filter("_l", lambda v, i: v == i.cast("bigint"))
    )
    return gathered.select("ckpt", run.cast("bigint").alias("n_layers"))


def require_layers(counts: DataFrame) -> DataFrame:
    """A checkpoint without layer 0 is an error."""

    bad = F.raise_error(F.concat(F.lit("no layers in checkpoint "), F.col("ckpt").cast("string")))
    return counts.filter(F.when(F.col("n_layers") > 0, F.lit(True)).otherwise(bad.cast("boolean")))


def missing_companions(catalog: DataFrame, anchor: str = "proj.weight") -> DataFrame:
    """``(ckpt, name)`` for each companion absent where ``anchor`` is present."""

    present = catalog.filter(F.col("name").isin(COMPANIONS)).select("ckpt", "name")
    found = present.groupBy("ckpt").agg(F.collect_set("name").alias("_found"))
    half = found.filter(F.array_contains("_found", anchor))
    wanted = F.array(*[F.lit(c) for c in COMPANIONS])
    return half.select("ckpt", F.explode(F.array_except(wanted, F.col("_found"))).alias("name"))


def own_or_borrowed(catalog: DataFrame, donor: DataFrame) -> DataFrame:
    """Companions of each checkpoint: its own where it has a projection, else the donor's.

    ``donor`` is ``(name, rows)``; it is reduced to one row per companion, four at most, which
    is what makes the broadcast safe.
    """

    own = catalog.filter(F.col("name").isin(COMPANIONS)).select("ckpt", "name", "rows")
    per_ckpt = catalog.groupBy("ckpt").agg(
        F.max((F.col("name") == "proj.weight").cast("int")).alias("_self")
    )
    wanted = per_ckpt.withColumn("name", F.explode(F.array(*[F.lit(c) for c in COMPANIONS])))
    lent = donor.filter(F.col("name").isin(COMPANIONS)).groupBy("name").agg(F.max("rows").alias("_lent"))
    joined = wanted.join(own, ["ckpt", "name"], "left").join(F.broadcast(lent), "name", "left")
    mine = F.col("_self") == 1
    return joined.select(
        "ckpt",
        "name",
        F.when(mine, F.col("rows")).otherwise(F.col("_lent")).alias("rows"),
        F.when(mine, F.lit("own")).otherwise(F.lit("borrowed")).alias("origin"),
    ).filter(F.col("rows").isNotNull())


# ---------------------------------------------------------------- configurations


def left_context_width(window):
    """Frames to the left, not counting the frame itself."""

    return window - 1


def compatibility(configs: DataFrame) -> DataFrame:
    """Add ``reason``; null when the configuration can be used. Absent flags mean false."""

    c = lambda field: F.col(f"encoder_config.{field}")
    flag = lambda field: F.coalesce(c(field), F.lit(False))
    reason = (
        F.when(
            c("subsampling_factor") != SUBSAMPLING,
            F.concat(F.lit("subsampling_factor is "), c("subsampling_factor").cast("string")),
        )
        .when(flag("attention_bias") | flag("convolution_bias"), F.lit("has biases"))
        .when(flag("scale_input"), F.lit("scales its input"))
    )
    return configs.withColumn("reason", reason)


def equal_widths(source: DataFrame, target: DataFrame, on: str = "ckpt") -> DataFrame:
    """Pairs of configurations with ``reason``, null where the two hidden sizes agree.

    Aligning needs two encoders of one width; a configuration without a counterpart is left out.
    """

    width = F.col("encoder_config.hidden_size")
    a = source.select(on, width.alias("source_width"))
    b = target.select(on, width.alias("target_width"))
    differ = F.concat(
        F.lit("widths differ: "), F.col("source_width").cast("string"), F.lit(" against "), F.col("target_width").cast("string")
    )
    same = F.col("source_width").eqNullSafe(F.col("target_width"))
    return a.join(b, on).withColumn("reason", F.when(~same, F.coalesce(differ, F.lit("width unknown"))))


def derive_config(catalog: DataFrame) -> DataFrame:
    """Each checkpoint's configuration, read off its layer count and tensor shapes; mel bins,
    subsampling and window are those of the container format."""

    def shape(name: str, dim: str):
        return F.max(F.when(F.col("name") == f"encoder.{name}", F.col(dim)))

    shapes = catalog.groupBy("ckpt").agg(
        shape("subsampling.linear.weight", "rows").alias("hidden_size"),
        shape("layers.0.self_attn.bias_u", "rows").alias("num_attention_heads"),
        shape("layers.0.feed_forward1.linear1.weight", "rows").alias("intermediate_size"),
        shape("layers.0.conv.depthwise_conv.weight", "width").alias("conv_kernel_size"),
    )
    constant = lambda value, name: F.lit(value).cast("bigint").alias(name)
    layers = count_layers(catalog).withColumnRenamed("n_layers", "num_hidden_layers")
    return shapes.join(layers, "ckpt").select(
        "ckpt", "num_hidden_layers", "hidden_size", "num_attention_heads", "intermediate_size",
        constant(MEL_BINS, "num_mel_bins"), constant(SUBSAMPLING, "subsampling_factor"),
        "conv_kernel_size", constant(LEFT_CONTEXT_WINDOW, "sliding_window"),
    )


# ---------------------------------------------------------------- arithmetic


def _three(base: DataFrame, ancestor: DataFrame, descendant: DataFrame) -> DataFrame:
    """The values of three checkpoints side by side; a missing row or another width is an error."""

    tables = {"base": base, "ancestor": ancestor, "descendant": descendant}
    return guarded_join({name: (table, "values") for name, table in tables.items()}, ["name", "row"])


def task_arithmetic(
    base: DataFrame, ancestor: DataFrame, descendant: DataFrame, weight: float
) -> DataFrame:
    """``base + weight * (descendant - ancestor)``, per name, row and position."""

    key = ["name", "row"]
    joined = _three(base, ancestor, descendant)
    delta = F.zip_with("descendant", "ancestor", lambda d, a: d - a)
    return joined.select(
        *key, F.zip_with("base", delta, lambda b, x: b + F.lit(weight) * x).alias("values")
    )


def lambda_sweep(
    base: DataFrame, ancestor: DataFrame, descendant: DataFrame, weights: Sequence[float]
) -> DataFrame:
    """One fused table per weight; the three tables are joined once for all weights."""

    key = ["name", "row"]
    joined = _three(base, ancestor, descendant).withColumn(
        "_x", F.zip_with("descendant", "ancestor", lambda d, a: d - a)
    )
    each = joined.withColumn("lambda", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    return each.select(
        "lambda", *key, F.zip_with("base", "_x", lambda b, x: b + F.col("lambda") * x).alias("values")
    )


def interpolate(left: DataFrame, right: DataFrame, weight: float) -> DataFrame:
    """``(1 - weight) * left + weight * right`` over the keys of ``left``."""

    joined = left_driven_join(left, right, ["name", "row"], "values")
    same = F.size("values") == F.size("_right")
    joined = joined.filter(_or_fail(same, "widths differ in "))
    mixed = F.zip_with(
        "values", "_right", lambda a, b: F.lit(1.0 - weight) * a + F.lit(weight) * b
    )
    return joined.select("name", "row", mixed.alias("values"))


def weight_drift(tensors: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Cosine of same-named tensors per pair of checkpoints.

    Rows of all checkpoints meet in guarded joins on (name, row), so a row absent from one of them
    fails the job; each pair is then a sum over rows, and no tensor is ever held whole.
    """

    names = sorted({c for pair in pairs for c in pair})
    wide = guarded_join(
        {f"_{c}": (tensors.filter(F.col("ckpt") == c), "values") for c in names}, ["name", "row"]
    )

    def inner(a: str, b: str):
        return F.aggregate(
            F.zip_with(f"_{a}", f"_{b}", lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v
        )

    sums = [F.sum(inner(a, b)).alias(f"ab_{a}_{b}") for a, b in pairs]
    sums += [F.sum(inner(c, c)).alias(f"sq_{c}") for c in names]
    reduced = wide.groupBy("name").agg(*sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("left"),
                F.lit(b).alias("right"),
                (F.col(f"ab_{a}_{b}") / F.sqrt(F.col(f"sq_{a}") * F.col(f"sq_{b}"))).alias("cosine"),
            )
            for a, b in pairs
        ]
    )
    return reduced.select("name", F.inline(rows))


# ---------------------------------------------------------------- change of basis


def tensor_cells(tensors: DataFrame, keys: Sequence[str] = ("name", "row")) -> DataFrame:
    return tensors.select(*keys, F.posexplode("values").alias("i", "v"))


def apply_operator(
    cells: DataFrame, ops: DataFrame, axis: str, weight: str, keys: Sequence[str] = ("name",)
) -> DataFrame:
    """Contract one axis of ``(keys..., row, i, v)`` cells with a plan operator.

    ``weight`` is ``analysis`` for an output axis and ``synthesis`` for an input axis. An index
    the operator does not know fails the job.
    """

    rest = [*keys, *[c for c in ("row", "i") if c != axis]]
    op = ops.select(F.col("src").alias("_s"), F.col("tgt").alias("_t"), F.col(weight).alias("_w"))
    joined = cells.join(op, F.col(axis) == F.col("_s"), "left")
    known = _or_fail(F.col("_w").isNotNull(), f"axis {axis} is wider than the operator: ")
    return (
        joined.filter(known)
        .groupBy(*rest, F.col("_t").alias(axis))
        .agg(F.sum(F.col("v") * F.col("_w")).alias("v"))
        .select(*keys, "row", "i", "v")
    )


# The group that owns each axis of a tensor, {n} being the layer.
# (name ending, group of the output axis, group of the input axis)
AXIS_OWNERS = [
    ("encoder.subsampling.linear.weight", "residual", None),
    ("encoder.subsampling.linear.bias", "residual", None),
    ("norm_self_att.weight", "residual", None),
    ("norm_self_att.bias", "residual", None),
    ("norm_out.weight", "residual", None),
    ("norm_out.bias", "residual", None),
    ("norm_feed_forward1.weight", "residual", None),
    ("norm_feed_forward1.bias", "residual", None),
    ("norm_feed_forward2.weight", "residual", None),
    ("norm_feed_forward2.bias", "residual", None),
    ("norm_conv.weight", "residual", None),
    ("norm_conv.bias", "residual", None),
    ("self_attn.q_proj.weight", "block.{n}.head", "residual"),
    ("self_attn.k_proj.weight", "block.{n}.head", "residual"),
    ("self_attn.v_proj.weight", "block.{n}.head", "residual"),
    ("self_attn.relative_k_proj.weight", "block.{n}.head", None),
    ("self_attn.o_proj.weight", "residual", "block.{n}.head"),
    ("self_attn.bias_u", "block.{n}.head", None),
    ("self_attn.bias_v", "block.{n}.head", None),
    ("feed_forward1.linear1.weight", "block.{n}.ffn1", "residual"),
    ("feed_forward1.linear2.weight", "residual", "block.{n}.ffn1"),
    ("feed_forward2.linear1.weight", "block.{n}.ffn2", "residual"),
    ("feed_forward2.linear2.weight", "residual", "block.{n}.ffn2"),
    ("conv.pointwise_conv1.weight", "block.{n}.glu", "residual"),
    ("conv.pointwise_conv2.weight", "residual", "block.{n}.conv"),
    ("conv.depthwise_conv.weight", "block.{n}.conv", None),
    ("conv.norm.weight", "block.{n}.conv", None),
    ("conv.norm.bias", "block.{n}.conv", None),
]


def axis_owners(names: DataFrame) -> DataFrame:
    """Add ``out_group`` and ``in_group`` to a table with a ``name`` column."""

    def owner(position: int) -> Column:
        cases = " ".join(
            f"WHEN endswith(name, '{row[0]}') THEN " + (f"'{row[position]}'" if row[position] else "NULL")
            for row in AXIS_OWNERS
        )
        return F.replace(F.expr(f"CASE {cases} END"), F.lit("{n}"), layer)

    layer = F.coalesce(layer_index(F.col("name")).cast("string"), F.lit(""))
    return names.withColumn("out_group", owner(1)).withColumn("in_group", owner(2))


def _or_fail(condition: Column, message: str) -> Column:
    """A filter that keeps rows meeting ``condition`` and fails the job on any other."""

    problem = F.raise_error(F.concat(F.lit(message), F.col("name"))).cast("boolean")
    return F.when(condition, F.lit(True)).otherwise(problem)


def _column_rules(ops: DataFrame) -> DataFrame:
    """One row per group: for each target index its list of (source, weight), both weights.

    At most one entry per plan cell, so a row is as large as the group's plan.
    """

    per_target = ops.groupBy("group", "tgt").agg(
        F.collect_list(F.struct("src", "analysis", "synthesis")).alias("parts"),
        F.max("src").alias("_last"),
    )
    return per_target.groupBy("group").agg(
        F.sort_array(F.collect_list(F.struct("tgt", "parts"))).alias("_rules"),
        (F.max("_last") + 1).alias("_sources"),
    )


def _turned(weight) -> Column:
    """The array ``values`` under ``_rules``; ``weight`` picks a part's weight."""

    return F.transform(
        "_rules",
        lambda rule: F.aggregate(
            rule["parts"],
            F.lit(0.0),
            lambda acc, part: acc + F.get("values", part["src"]) * weight(part),
        ),
    )


def turn_values(tensors: DataFrame, ops: DataFrame, weight: str) -> DataFrame:
    """Turn the axis inside ``values`` by one operator, row by row: nothing is exploded or shuffled.

    ``weight`` is ``analysis`` or ``synthesis``. Another width than the operator's fails the job. Pass a
    materialised ``ops``: its cells are counted, and broadcast when they are few.
    """

    one = F.lit(0).alias("group")
    rules = _column_rules(ops.select(one, "src", "tgt", "analysis", "synthesis")).withColumnRenamed("group", "_op")
    small = ops.count() * CELL_BYTES <= BROADCAST_BYTES
    joined = tensors.withColumn("_op", F.lit(0)).join(F.broadcast(rules) if small else rules, "_op")
    fits = F.size("values") == F.col("_sources")
    turned = joined.filter(_or_fail(fits, "inner axis and operator differ in size: "))
    return turned.withColumn("values", _turned(lambda part: part[weight])).select(*tensors.columns)


def rebase(tensors: DataFrame, ops: DataFrame) -> DataFrame:
    """Express tensors in another basis: ``(name, row, values)``.

    ``ops`` is ``(group, src, tgt, analysis, synthesis)`` for the groups that have a plan. A
    one-dimensional tensor (``ndim`` 1) stores its only axis in ``values``, and its output
    group turns that axis. The axis inside ``values`` is turned row by row without exploding;
    the row axis is one join on (group, row) and a vector sum. Pass a materialised ``ops``: its
    cells are counted, and broadcast only when they are few, because one group usually owns
    most rows.
    """

    small = ops.count() * CELL_BYTES <= BROADCAST_BYTES
    sent = F.broadcast if small else (lambda df: df)

    owned = axis_owners(tensors)
    flat = F.col("ndim") == 1
    owned = (
        owned.withColumn("_inner", F.when(flat, F.col("out_group")).otherwise(F.col("in_group")))
        .withColumn("_outer", F.when(~flat, F.col("out_group")))
        .withColumn("_flat", flat)
    )
    rules = _column_rules(ops).withColumnRenamed("group", "_inner")
    joined = owned.join(sent(rules), "_inner", "left")
    fits = F.col("_rules").isNull() | (F.size("values") == F.col("_sources"))
    joined = joined.filter(_or_fail(fits, "inner axis and operator differ in size: "))
    weight = lambda part: F.when(F.col("_flat"), part["analysis"]).otherwise(part["synthesis"])
    turned = _turned(weight)
    inner = joined.select(
        "name",
        F.col("row").cast("bigint").alias("row"),
        "_outer",
        F.when(F.col("_rules").isNull(), F.col("values")).otherwise(turned).alias("values"),
    )
    moves = ops.select(
        F.col("group").alias("_outer"),
        F.col("src").cast("bigint").alias("row"),
        F.col("tgt").cast("bigint").alias("_to"),
        F.col("analysis").alias("_w"),
    )
    planned = ops.select(F.col("group").alias("_outer")).distinct()
    planned = sent(planned)
    stay = inner.join(planned, "_outer", "left_anti").select("name", "row", "values")
    to_move = inner.join(planned, "_outer", "left_semi").join(sent(moves), ["_outer", "row"], "left")
    known = F.col("_to").isNotNull()
    moved = to_move.filter(_or_fail(known, "row axis is wider than the operator: ")).select(
        "name", F.col("_to").alias("row"), scale(F.col("values"), F.col("_w")).alias("values")
    )
    summed = moved.groupBy("name", "row").agg(
        vector_to_array(Summarizer.sum(array_to_vector("values"))).alias("values")
    )
    return stay.unionByName(summed)


def head_operators(plan_ops: DataFrame, d_head: int) -> DataFrame:
    """Grouped head operators expanded so that a head moves as a whole."""

    from embedlab.operators.matching import expand_ops

    return expand_ops(plan_ops, d_head)


def glu_operators(conv_ops: DataFrame, width: int) -> DataFrame:
    """The gated axis is two copies of the convolution axis."""

    shift = F.explode(F.array(F.lit(0), F.lit(width)))
    doubled = conv_ops.withColumn("_at", shift)
    return (
        doubled.withColumn("src", F.col("src") + F.col("_at"))
        .withColumn("tgt", F.col("tgt") + F.col("_at"))
        .withColumn("group", F.regexp_replace("group", r"\.conv$", ".glu"))
        .drop("_at")
    )


def aligned_tensors(
    spark: SparkSession,
    source: DataFrame,
    projection: tuple,
    featurizer: DataFrame,
    report: dict,
    ckpt: str,
) -> DataFrame:
    """Encoder tensors unchanged, plus projection, featurizer and provenance columns."""

    weight, bias = projection
    rows = [("proj.weight", i, [float(v) for v in row]) for i, row in enumerate(weight)]
    rows.append(("proj.bias", 0, [float(v) for v in bias]))
    added = spark.createDataFrame(rows, "name string, row bigint, values array<double>")
    kept = select_tensors(source, "encoder.").select("name", F.col("row").cast("bigint").alias("row"), "values")
    prefixed = featurizer.select(
        F.concat(F.lit("preprocessor.featurizer."), F.col("name")).alias("name"),
        F.col("row").cast("bigint").alias("row"), "values",
    )
    whole = kept.unionByName(added).unionByName(prefixed)
    return whole.select(
        F.lit(ckpt).alias("ckpt"), "name", "row", "values",
        F.lit(str(report.get("source"))).alias("derived_from"),
        F.lit(str(report.get("map", "?"))).alias("alignment_map"),
        F.lit(int(len(weight))).cast("bigint").alias("projection_dim"),
        F.lit(int(report.get("fit_frames", 0))).cast("bigint").alias("fit_frames"),
    )
