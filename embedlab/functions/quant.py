"""Half precision and 8-bit block quantisation as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of IEEE half precision and of the 8-bit block format.
HALF_SMALLEST_NORMAL_EXPONENT = -14
HALF_MANTISSA_BITS = 10
HALF_OVERFLOW = 65520.0
BLOCK = 32
CODE_MAX = 127.0


def f16(value: Column) -> Column:
    """Round a double to half precision and back, ties to even."""

    magnitude = F.abs(value)
    exponent = F.greatest(F.floor(F.log2(magnitude)), F.lit(HALF_SMALLEST_NORMAL_EXPONENT))
    step = F.pow(F.lit(2.0), (exponent - HALF_MANTISSA_BITS).cast("double"))
    return (
        F.when(magnitude == 0.0, F.lit(0.0))
        .when(F.isnan(value), value)
        .when(magnitude >= HALF_OVERFLOW, F.signum(value) * F.lit(float("inf")))
        .otherwise(F.rint(value / step) * step)
    )


def block_peak(block: Column) -> Column:
    return F.array_max(F.transform(block, lambda v: F.abs(v)))


def block_scale(peak: Column) -> Column:
    """The stored scale: half precision of peak / 127."""

    return f16(peak / CODE_MAX)


def block_codes(block: Column, peak: Column) -> Column:
    """Signed codes; the division uses the scale before it is rounded.

    ``peak`` is passed in so that it is evaluated once per block, not once per value.
    """

    step = F.greatest(peak / CODE_MAX, F.lit(1e-30))
    return F.transform(
        block,
        lambda v: F.greatest(F.least(F.rint(v / step), F.lit(127.0)), F.lit(-128.0)),
    )


def dequantize(scale: Column, codes: Column) -> Column:
    return F.transform(codes, lambda c: c * scale)


def split_blocks(values: Column) -> Column:
    """``ARRAY<ARRAY<DOUBLE>>`` of 32 values each; other widths are an error."""

    size = F.size(values)
    blocks = F.transform(
        F.sequence(F.lit(0), (size / BLOCK).cast("int") - 1),
        lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)),
    )
    return F.when(
        (size % BLOCK != 0) | (size == 0),
        F.raise_error(F.concat(F.lit("row width is not a multiple of 32: "), size.cast("string"))),
    ).otherwise(blocks)


def q8_0(values: Column) -> Column:
    """Quantise and restore a whole row, block by block."""

    sized = F.transform(
        split_blocks(values),
        lambda block: F.struct(block.alias("v"), block_peak(block).alias("peak")),
    )
    coded = F.transform(
        sized,
        lambda b: F.struct(
            block_codes(b["v"], b["peak"]).alias("codes"), block_scale(b["peak"]).alias("scale")
        ),
    )
    return F.flatten(F.transform(coded, lambda b: dequantize(b["scale"], b["codes"])))
