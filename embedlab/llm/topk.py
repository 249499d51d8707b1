"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length and cut into buckets. For a query with a known k-th score, a bucket of
maximal length m can only help where the cosine reaches score / (|query| m): above 1 the bucket is
skipped, otherwise short vectors are cut off by length, or vectors are kept only if their largest
query coordinates lie in the range the threshold allows. What is left is multiplied exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embedlab.llm.rows import kept, prepare, record_batch

SCALE = 1024
TOP = 10
BUCKET_VECTORS = 1024
PART_VECTORS = 8192
QUERY_BLOCK = 256
FOCUS = 3
COORDINATE_FROM = 0.2
SLACK = 1e-9

_BLOCK = pa.schema(
    [("_part", pa.int64()), ("_seq", pa.int64()), ("_width", pa.int64()), ("_ids", pa.binary()), ("_data", pa.binary())]
)
BLOCK_SCHEMA = "_part long, _seq long, _width long, _ids binary, _data binary"


def integer_vectors(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``_id``, ``_v`` = floor(1024 x) per component and ``_norm2``, of the rows that take part."""

    usable = (
        F.col(id_column).isNotNull()
        & F.col(vector_column).isNotNull()
        & F.forall(
            vector_column,
            lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")),
        )
    )
    return (
        table.where(usable)
        .select(
            F.col(id_column).cast("long").alias("_id"),
            F.transform(vector_column, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))).alias("_v"),
        )
        .withColumn("_norm2", F.aggregate("_v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    )


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer products; scores beyond a long saturate."""

    width = min(queries.shape[1], vectors.shape[1])
    queries, vectors = queries[:, :width], vectors[:, :width]
    largest = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(vectors.astype(float)).max(initial=0))
    if largest * width < 2**53:
        return (queries.astype(float) @ vectors.astype(float).T).astype(np.int64)
    if largest * width < 2**62:
        return queries @ vectors.T
    exact = queries.astype(object) @ vectors.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class Bucket:
    """Vectors of similar length, longest first."""

    def __init__(self, ids: np.ndarray, data: np.ndarray) -> None:
        self.ids, self.data = ids, data
        self.norms = np.sqrt((data.astype(float) ** 2).sum(axis=1))
        self.units = data / np.where(self.norms > 0, self.norms, 1.0)[:, None]

    def candidates(self, query: np.ndarray, norm: float, threshold: float) -> np.ndarray | None:
        """Places that can reach ``threshold``; None for all."""

        if threshold <= 0 or norm == 0:
            return None
        cosine = threshold / (norm * self.norms[0]) if self.norms[0] > 0 else np.inf
        if cosine > 1 + SLACK:
            return np.empty(0, np.int64)
        long_enough = int(np.searchsorted(-self.norms, -threshold / norm * (1 - SLACK), side="right"))
        if cosine < COORDINATE_FROM:
            return np.arange(long_enough)
        unit = query / norm
        spread = np.sqrt(max(0.0, 1 - min(cosine, 1.0) ** 2))
        inside = np.ones(long_enough, bool)
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            half = spread * np.sqrt(max(0.0, 1 - unit[f] ** 2)) + SLACK
            middle, values = unit[f] * cosine, self.units[:long_enough, f]
            inside &= values >= middle - half if unit[f] >= 0 else values <= middle + half
            if cosine > abs(unit[f]):  # else the query's own direction is inside, and all beyond it
                inside &= values <= middle + half if unit[f] >= 0 else values >= middle - half
        return np.flatnonzero(inside)


class Best:
    """The k best (score, id) of each query so far; higher scores first, then smaller ids."""

    def __init__(self, ids: np.ndarray, k: int, threshold: np.ndarray) -> None:
        self.ids, self.k, self.threshold = ids, k, threshold.astype(float)
        self.scores = [np.empty(0, np.int64) for _ in ids]
        self.found = [np.empty(0, np.int64) for _ in ids]

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        other = (ids != self.ids[query]) & (scores >= self.threshold[query])
        scores = np.concatenate((self.scores[query], scores[other]))
        ids = np.concatenate((self.found[query], ids[other]))
        if len(scores) > self.k:
            last = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            stay = scores >= last
            scores, ids = scores[stay], ids[stay]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[query], self.found[query] = scores[order], ids[order]
        if len(order) == self.k:
            self.threshold[query] = max(self.threshold[query], float(scores[order[-1]]))


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["_ids"], np.int64)
    return ids, np.frombuffer(row["_data"], np.int64).reshape(len(ids), row["_width"])


def _packer(rows_per_block: int) -> Callable:
    """Blocks of the rows of a partition, in their order; the partition's number is the part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, rows_per_block):
                piece = batch.slice(start, rows_per_block)
                lengths = np.asarray(pc.list_value_length(piece.column("_v")))
                width = int(lengths.max())
                data = np.zeros((len(lengths), width), np.int64)
                data[np.arange(width) < lengths[:, None]] = piece.column("_v").flatten().to_numpy()
                ids = piece.column("_id").to_numpy(zero_copy_only=False)
                yield record_batch(
                    {"_part": [part], "_seq": [seq], "_width": [width], "_ids": [ids.astype(np.int64).tobytes()], "_data": [data.tobytes()]},
                    _BLOCK,
                )
                seq += 1

    return pack


def _searcher(k: int, seed) -> Callable:
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a part: its vector buckets first, longest first, then query blocks one by one."""

        part, buckets = None, []
        first = Bucket(*_unpack(seed)) if seed else None
        for batch in batches:
            for row in batch.to_pylist():
                if row["_part"] != part:
                    part, buckets = row["_part"], []
                ids, data = _unpack(row)
                if not row["_query"]:
                    buckets.append(Bucket(ids, data))
                    continue
                threshold = np.full(len(ids), -np.inf)
                if first is not None and len(first.ids) > k:
                    scores = products(data, first.data)
                    for q in range(len(ids)):
                        own = scores[q][first.ids != ids[q]]
                        if len(own) >= k:
                            threshold[q] = np.partition(own, len(own) - k)[len(own) - k]
                best = Best(ids, k, threshold)
                norms = np.sqrt((data.astype(float) ** 2).sum(axis=1))
                for bucket in buckets:
                    everything = []
                    for q in range(len(ids)):
                        chosen = bucket.candidates(data[q], norms[q], best.threshold[q])
                        if chosen is None or 2 * len(chosen) > len(bucket.ids):
                            everything.append(q)
                        elif len(chosen):
                            best.add(q, products(data[q : q + 1], bucket.data[chosen])[0], bucket.ids[chosen])
                    if everything:
                        scores = products(data[everything], bucket.data)
                        for i, q in enumerate(everything):
                            best.add(q, scores[i], bucket.ids)
                counts = [len(x) for x in best.found]
                yield record_batch(
                    {
                        "query_id": np.repeat(ids, counts),
                        "vec_id": np.concatenate(best.found),
                        "score": np.concatenate(best.scores),
                    },
                    schema,
                )

    return search


def top_products(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """The k best inner products of each query: query_id, rank (from 1), vec_id, score.

    Both inputs come from ``integer_vectors``. A query never meets vectors of its own id; ties go to
    the smaller id. Vectors of different widths are compared as if padded with zeros. A repeated
    query counts once; of repeated vectors each row counts. Fewer than k vectors give fewer rows, and
    empty inputs none.

    Vectors are ranged by length into parts of about ``PART_VECTORS``; every query block visits
    every part, and a task holds one part. The longest bucket, of bounded size, goes to all tasks to
    start the thresholds.
    """

    spark = vectors.sparkSession
    prepare(spark)
    parts = max(1, -(-vectors.count() // PART_VECTORS))
    order = [F.col("_norm2").desc(), F.col("_id")]
    buckets = kept(
        vectors.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select("_id", "_v")
        .mapInArrow(_packer(BUCKET_VECTORS), BLOCK_SCHEMA),
        "buckets",
    )
    seed = buckets.orderBy("_part", "_seq").limit(1).collect()
    blocks = (
        queries.dropDuplicates(["_id", "_v"])
        .select("_id", "_v")
        .mapInArrow(_packer(QUERY_BLOCK), BLOCK_SCHEMA)
        .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    )
    visits = buckets.withColumn("_query", F.lit(False)).unionByName(blocks.withColumn("_query", F.lit(True)))
    found = (
        visits.repartition(parts, "_part")
        .sortWithinPartitions("_part", "_query", "_seq")
        .mapInArrow(_searcher(k, seed[0].asDict() if seed else None), "query_id long, vec_id long, score long")
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
