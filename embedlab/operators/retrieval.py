"""Mean pooling and parallel-corpus retrieval."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedlab.functions import vectors as V
from embedlab.operators.arrow import matrix
from embedlab.operators.scoring import linear_quantile
from embedlab.session import BROADCAST_BYTES, kept_summary, materialize

NORM_FLOOR = 1e-12
BLOCK_ROWS = 16_384
# similarities held at once, and vector cells gathered at once for ties: 8 MB each
CHUNK_CELLS = 1 << 20
# dot products closer than this to the truth are compared again in one fixed order
TIE_BAND = 1e-9


def mean_pool(
    frames: DataFrame, by: Sequence[str], columns: Sequence[str], width: int | None = None
) -> DataFrame:
    """Unweighted mean vector per key; partial sums before the shuffle, no exploding.

    Pool before projecting: a projection is affine, so it commutes with the mean.
    """

    if width is not None and width <= V.UNROLL_LIMIT:
        means = [F.array(*[F.avg(F.col(c)[i]) for i in range(width)]).alias(c) for c in columns]
    else:
        means = [vector_to_array(Summarizer.mean(array_to_vector(c))).alias(c) for c in columns]
    return frames.groupBy(*by).agg(*means)


def center_and_normalize(
    vectors: DataFrame, by: Sequence[str], columns: Sequence[str] = ("v",), width: int | None = None
) -> DataFrame:
    """Subtract each set's own mean and divide by the norm, column by column."""

    means = mean_pool(vectors, by, columns, width)
    means = materialize(means.toDF(*by, *[f"_mean_{c}" for c in columns]))
    # the size is measured, as widths may be unknown
    cells = means.agg(F.sum(sum(F.size(f"_mean_{c}") for c in columns)).cast("long"), F.count(F.lit(1))).first()
    small = 8 * (cells[0] or 0) + 64 * cells[1] <= BROADCAST_BYTES
    out = vectors.join(F.broadcast(means) if small else means, list(by))
    for c in columns:
        out = out.withColumn(c, V.subtract(F.col(c), F.col(f"_mean_{c}")))
        out = out.withColumn(
            f"_len_{c}", F.greatest(V.norm(F.col(c), width), F.lit(NORM_FLOOR))
        )
        out = out.withColumn(c, V.divide(F.col(c), F.col(f"_len_{c}")))
    return out.select(*vectors.columns)


def _ordered_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise dot products summed left to right, the order the JVM uses."""

    return np.cumsum(a * b, axis=1)[:, -1] + 0.0


def _count_above(
    p: np.ndarray, r: np.ndarray, bar: np.ndarray, own: np.ndarray, others: np.ndarray
) -> np.ndarray:
    """Per row of ``p``: rows of ``r`` under another key whose product is above ``bar``.

    Products within the tie band are computed again in the order ``bar`` was. Memory beside the two
    blocks is bounded by ``CHUNK_CELLS``, whatever their sizes and however many products tie.
    """

    greater = np.zeros(len(p), dtype=np.int64)
    step = max(1, CHUNK_CELLS // max(1, len(r)))
    pairs = max(1, CHUNK_CELLS // max(1, p.shape[1]))
    for begin in range(0, len(p), step):
        part, level = p[begin : begin + step], bar[begin : begin + step]
        other = own[begin : begin + step, None] != others
        similarity = part @ r.T
        above = similarity > level[:, None]
        rows, columns = np.nonzero((np.abs(similarity - level[:, None]) <= TIE_BAND) & other)
        for start in range(0, len(rows), pairs):
            a, b = rows[start : start + pairs], columns[start : start + pairs]
            above[a, b] = _ordered_dot(part[a], r[b]) > level[a]
        greater[begin : begin + step] = (above & other).sum(axis=1)
    return greater


def truth_rank(
    probes: DataFrame,
    references: DataFrame,
    by: Sequence[str],
    key: str,
    column: str = "v",
    width: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Ranks for two tables that share ``by`` and ``key``; see :func:`rank_matched`."""

    matched = probes.select(*by, key, F.col(column).alias("v")).join(
        references.select(*by, key, F.col(column).alias("r")), [*by, key]
    )
    return rank_matched(matched, by, key, width, block_rows)


def rank_matched(
    matched: DataFrame,
    by: Sequence[str],
    key: str,
    width: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rank of the matching reference ``r`` of each probe ``v``: one plus how many other
    references of the set are strictly more similar.

    Similarities are never written out. Probes and references are cut into hashed blocks of
    about ``block_rows``; each pair of blocks is one matrix product in one task that returns a
    count per probe, so a hot set is spread over many equal tasks. The matching reference is
    left out of the counting, so two summation orders cannot make a row beat itself.

    ``matched`` is read three times: pass a pooled table that was materialised.
    """

    by = list(by)
    sizes = kept_summary(
        matched.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_blocks"))
    )
    home = F.pmod(F.xxhash64(key), F.col("_blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))
    truth = matched.withColumn("truth", V.dot(F.col("v"), F.col("r"), width))
    left = (
        truth.select(*by, key, F.col("v").alias("_p"), "truth")
        .join(sizes, by)
        .withColumn("_pb", home)
        .withColumn("_rb", every)
        .drop("_blocks")
    )
    right = (
        matched.select(*by, key, F.col("r").alias("_r"))
        .join(sizes, by)
        .withColumn("_rb", home)
        .withColumn("_pb", every)
        .drop("_blocks")
    )
    fields = [truth.schema[name] for name in [*by, key]]
    schema = T.StructType([*fields, T.StructField("greater", T.LongType())])
    cell = [*by, "_pb", "_rb"]

    def count_greater(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        greater = np.zeros(mine.num_rows, dtype=np.int64)
        if mine.num_rows and theirs.num_rows:
            p, r = matrix(mine["_p"].combine_chunks()), matrix(theirs["_r"].combine_chunks())
            own, others = mine[key].to_numpy(), theirs[key].to_numpy()
            greater = _count_above(p, r, mine["truth"].to_numpy(), own, others)
        return mine.select([*by, key]).append_column("greater", pa.array(greater))

    # new attribute ids: both sides may come from the same table
    right = right.toDF(*right.columns)
    counted = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(count_greater, schema)
    return counted.groupBy(*by, key).agg((F.sum("greater") + 1).alias("rank"))


def retrieval_summary(ranks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Top-1 and top-5 shares, median rank, size and chance level per set.

    ``ranks`` is read three times: keep it first.
    """

    by = list(by)
    shares = ranks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("rank") <= 1).cast("double")).alias("top1"),
        F.avg((F.col("rank") <= 5).cast("double")).alias("top5"),
    )
    middle = linear_quantile(
        ranks.withColumn("_rank", F.col("rank").cast("double")), by, "_rank", 0.5, "median_rank"
    )
    shares = shares.join(middle, by)
    return shares.withColumn("chance_top1", 1.0 / F.col("n"))
