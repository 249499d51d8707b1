import random

import numpy as np
import pytest
from compare import connect, difference

from embedlab.llm import topk
from embedlab.llm.queries import ORACLE, QUERIES
from embedlab.llm.topk import Bucket, integer_vectors, products, top_products

SCHEMA = "vec_id long, embedding array<float>, _id int, SCORE string"


def _brute(rows, k):
    floors = [
        (i, [int(np.floor(1024 * float(np.float32(x)))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out, seen = [], set()
    for q, a in floors:
        if q % 4 or (q, tuple(a)) in seen:
            continue
        seen.add((q, tuple(a)))
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in floors if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("bucket, part, coordinate", [(4, 16, 0.0), (1024, 8192, 0.2), (8, 30, 2.0)])
def test_against_brute_force(spark, monkeypatch, bucket, part, coordinate):
    monkeypatch.setattr(topk, "BUCKET_VECTORS", bucket)
    monkeypatch.setattr(topk, "PART_VECTORS", part)
    monkeypatch.setattr(topk, "COORDINATE_FROM", coordinate)
    rng = random.Random(bucket)
    rows = [(i, [rng.gauss(0, 1) * rng.choice([0.1, 1, 5]) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, [0.5] * 6) for i in range(30)]
    rows += [(300, None), (304, [1.0, None]), (308, [float("nan")] * 6), (312, [float("inf")] * 6)]
    rows += [(None, [1.0] * 6), (316, []), (320, [2.0, 3.0]), rows[4], rows[5]]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    vectors = integer_vectors(table)
    mine = top_products(vectors, vectors.where("_id % 4 = 0"), 5).collect()
    assert sorted(tuple(r) for r in mine) == _brute(rows, 5)


def test_few_and_no_vectors(spark):
    table = spark.createDataFrame([(0, [1.0], 0, "x"), (1, [2.0], 0, "y")], SCHEMA)
    vectors = integer_vectors(table)
    assert [tuple(r) for r in top_products(vectors, vectors.where("_id = 0")).collect()] == [(0, 1, 1, 2 * 1024**2)]
    none = vectors.limit(0)
    assert top_products(none, none).count() == 0


def test_large_components_stay_exact():
    a = np.array([[2**40, 3], [-(2**31), 2**31]])
    assert products(a, a).tolist() == [[2**63 - 1, -(2**63) if -(2**71) + 3 * 2**31 < -(2**63) else 0], [-(2**63), 2**63 - 1 if 2**63 > 2**63 - 1 else 0]]


def test_pruning_never_loses_a_vector():
    rng = np.random.default_rng(1)
    for _ in range(200):
        data = np.floor(rng.normal(size=(50, 4)) * rng.choice([10, 1000], (50, 1))).astype(np.int64)
        data = data[np.argsort(-(data.astype(float) ** 2).sum(axis=1), kind="stable")]
        bucket = Bucket(np.arange(50), data)
        query = np.floor(rng.normal(size=4) * 100).astype(np.int64)
        scores = data @ query
        threshold = float(np.sort(scores)[-5])
        chosen = bucket.candidates(query, float(np.sqrt((query**2).sum())), threshold)
        if chosen is not None:
            assert set(np.flatnonzero(scores >= threshold)) <= set(chosen)


def test_query_against_sql(spark, folder):
    name = "op6_top_products"
    assert difference(QUERIES[name](spark, folder), connect(folder), ORACLE[name]) is None
