"""The scalar functions for SQL users, as SQL functions: no Python at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession

def _half(v: str) -> str:
    """Half-precision rounding of ``v`` as SQL text; a SQL function cannot sit in a lambda."""

    step = f"power(2D, greatest(floor(log2(abs({v}))), -14) - 10)"
    return (
        f"CASE WHEN {v} = 0D THEN 0D WHEN abs({v}) >= 65520D THEN signum({v}) * double('Infinity') "
        f"ELSE rint({v} / {step}) * {step} END"
    )


_F16 = f"CREATE OR REPLACE TEMPORARY FUNCTION f16(v DOUBLE) RETURNS DOUBLE RETURN {_half('v')}"

_COSINE = """CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN
aggregate(zip_with(a, b, (u, v) -> u * v), 0D, (s, x) -> s + x)
/ (greatest(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)), 1e-8D)
   * greatest(sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 1e-8D))"""

_Q8 = f"""CREATE OR REPLACE TEMPORARY FUNCTION q8_0(a ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN
CASE WHEN size(a) % 32 <> 0 THEN raise_error('row width is not a multiple of 32') ELSE
flatten(transform(
  transform(
    transform(sequence(0, int(size(a) / 32) - 1), b -> slice(a, b * 32 + 1, 32)),
    w -> named_struct('v', w, 'step', array_max(transform(w, x -> abs(x))) / 127D)),
  k -> transform(k.v, x -> greatest(least(rint(x / greatest(k.step, 1e-30D)), 127D), -128D)
    * {_half('k.step')}))) END"""


def register_sql_functions(spark: SparkSession) -> None:
    """``f16``, ``cosine`` and ``q8_0`` for this session's SQL."""

    for statement in (_F16, _COSINE, _Q8):
        spark.sql(statement)
