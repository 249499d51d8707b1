"""Vector arithmetic on ``ARRAY<DOUBLE>`` columns.

With a small ``width`` the sum is unrolled into plain multiplications, which stay inside
whole-stage code generation; otherwise a higher-order function is used, because long
unrolled code costs more to compile than it saves. Both add from left to right, so they
return the same bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNROLL_LIMIT = 16


def as_doubles(values: Column) -> Column:
    return values.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column, width: int | None = None) -> Column:
    if width is not None and width <= UNROLL_LIMIT:
        return reduce(lambda acc, i: acc + a[i] * b[i], range(width), F.lit(0.0))
    return total(F.zip_with(a, b, lambda u, v: u * v))


def squared_norm(a: Column, width: int | None = None) -> Column:
    return dot(a, a, width)


def norm(a: Column, width: int | None = None) -> Column:
    return F.sqrt(squared_norm(a, width))


def cosine(a: Column, b: Column, width: int | None = None, floor: float = 1e-8) -> Column:
    """Cosine with each norm held at ``floor`` or above."""

    return dot(a, b, width) / (
        F.greatest(norm(a, width), F.lit(floor)) * F.greatest(norm(b, width), F.lit(floor))
    )


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda u, v: u + v)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda u, v: u - v)


def scale(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda v: v * factor)


def divide(a: Column, by: Column) -> Column:
    return F.transform(a, lambda v: v / by)


def outer(a: Column, b: Column) -> Column:
    """Rows of the outer product, ``ARRAY<ARRAY<DOUBLE>>``."""

    return F.transform(a, lambda u: F.transform(b, lambda v: u * v))


def eye(size: int) -> Column:
    steps = F.sequence(F.lit(0), F.lit(size - 1))
    return F.transform(steps, lambda i: F.transform(steps, lambda j: (i == j).cast("double")))


def diagonal(values: Column) -> Column:
    """Square matrix with ``values`` on the diagonal."""

    return F.transform(
        values,
        lambda v, i: F.transform(values, lambda w, j: F.when(i == j, v).otherwise(F.lit(0.0))),
    )


def trace(matrix: Column) -> Column:
    return total(F.transform(matrix, lambda row, i: row[i]))


def rms(a: Column) -> Column:
    return F.sqrt(squared_norm(a) / F.size(a))


def apply_affine(x: Column, weight: list[list[float]], bias: list[float]) -> Column:
    """``x @ weight + bias`` for a small constant map, fully unrolled."""

    outputs = []
    for j, offset in enumerate(bias):
        terms = reduce(
            lambda acc, i: acc + x[i] * F.lit(float(weight[i][j])), range(len(weight)), F.lit(0.0)
        )
        outputs.append(terms + F.lit(float(offset)))
    return F.array(*outputs)


def round_metric(value: Column, digits: int = 6) -> Column:
    """Rounded, with negative zero folded into zero."""

    rounded = F.round(value, digits)
    return F.when(rounded == 0.0, F.lit(0.0)).otherwise(rounded)


def signed4(value: Column) -> Column:
    """Fixed signed format with four decimals; half-even like C ``printf``."""

    return F.format_string("%+.4f", value)
