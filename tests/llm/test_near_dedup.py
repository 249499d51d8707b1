import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from embedlab.llm import near_dedup
from embedlab.llm.components import connected_components
from embedlab.llm.near_dedup import drop_near_duplicates, near_duplicates, probability_jaccard, signatures
from embedlab.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, _key string, _NTH int"


def _bag(text, size=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    n = min(size, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def _similarity(a, b):
    total = 0.0
    for i in a.keys() & b.keys():
        total += 1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys())
    return total


def _classes(rows):
    bags = [_bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(set)
    for i, b in enumerate(bags):
        for s in b:
            where[s].add(i)
    for i, b in enumerate(bags):
        for j in {j for s in b for j in where[s] if j < i}:
            if root(i) != root(j) and _similarity(b, bags[j]) >= 0.8:
                parent[root(i)] = root(j)
        if not b:
            for j in range(i):
                if rows[j] == rows[i] or (rows[j][0] == rows[i][0] and not (rows[j][1] or rows[i][1])):
                    parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    out = []
    for i, (d, _) in enumerate(rows):
        members = groups[root(i)]
        out.append((d, min((m for m in members if m is not None), default=None), len(members)))
    return sorted(out, key=repr)


def _rows(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(60))
    rows = [(None, None), (1, ""), (1, " "), (2, "One two"), (3, "one TWO"), (4, "one two three"), (None, "one two")]
    base = [word() for _ in range(150)]
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(len(copy))] = word()
        if rng.random() < 0.3:
            copy = copy + [word() for _ in range(rng.randrange(60))]
        rows.append((10 + i, " ".join(copy)))
    rows += [(100 + i, " ".join(word() for _ in range(rng.randrange(1, 200)))) for i in range(40)]
    rows += [(200, "ha " * 5000), (201, "ha " * 5005), rows[12], rows[110 - 10]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_classes_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", block)
    rows = _rows(block)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    mine = near_duplicates(docs).collect()
    expected = _classes(rows)
    assert sorted((tuple(r) for r in mine), key=repr) == expected
    if block == 4:
        left = drop_near_duplicates(docs)
        assert left.columns == docs.columns
        firsts = Counter(c for d, c, n in expected if c is not None)
        got = Counter(r.doc_id for r in left.collect() if r.doc_id is not None)
        assert set(got) == set(firsts)


def test_query_against_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    mine = sorted((tuple(r) for r in QUERIES["op3_near_dedup"](spark, folder).collect()), key=repr)
    assert mine == _classes(rows)
    assert any(n > 1 for _, _, n in mine)


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(0)
    estimates, truths = [], []
    for _ in range(60):
        items = rng.integers(1, 2**63, 40).astype(np.uint64)
        x, y = rng.integers(0, 4, 40).astype(float), rng.integers(0, 4, 40).astype(float)
        a, b = (items[x > 0], x[x > 0]), (items[y > 0], y[y > 0])
        a, b = ((v[np.argsort(v)], w[np.argsort(v)]) for v, w in (a, b))
        owner = np.repeat([0, 1], [len(a[0]), len(b[0])])
        table = signatures(owner, np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1])), 2)
        estimates.append((table[0] == table[1]).mean())
        truths.append(probability_jaccard(a, b))
        brute = _similarity(Counter(dict(zip(*a))), Counter(dict(zip(*b))))
        assert np.isclose(truths[-1], brute)
    assert abs(np.mean(np.array(estimates) - truths)) < 0.02
    assert np.abs(np.array(estimates) - truths).max() < 0.2


def test_bounds_are_never_below_the_value():
    rng = np.random.default_rng(1)
    bags = []
    for k in range(40):
        items = rng.choice(60, rng.integers(1, 50), replace=False).astype(np.uint64)
        counts = np.ones(len(items)) if k % 2 else rng.integers(1, 5, len(items)).astype(float)
        bags.append((np.sort(items), counts))
    place = near_dedup.Bags(bags)
    for i in range(40):
        others = np.array([j for j in range(40) if j != i])
        bounds = place.bounds(i, others)
        exact = np.array([probability_jaccard(bags[i], bags[j]) for j in others])
        assert (bounds >= exact - 1e-12).all()
        plain = (others % 2 == 1) & (i % 2 == 1)
        assert np.allclose(bounds[plain], exact[plain])
    assert place.row.sum() == 0


def test_outliers_of_a_large_class_meet_all_of_it(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "RUN_ROWS", 8)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(80):
        copy = list(base)
        for _ in range(1 if i < 60 else rng.randrange(2, 7)):
            copy[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    mine = near_duplicates(spark.createDataFrame([(d, t, "", 0) for d, t in rows], SCHEMA)).collect()
    assert sorted((tuple(r) for r in mine), key=repr) == _classes(rows)


def test_the_estimate_hardly_drops_a_pair_at_the_threshold():
    n, similarity = near_dedup.REGISTERS, near_dedup.THRESHOLD
    agree = similarity + (1 - similarity) / 256
    lost = sum(
        math.comb(n, k) * agree**k * (1 - agree) ** (n - k)
        for k in range(n + 1)
        if k / n < similarity - near_dedup.ESTIMATE_MARGIN
    )
    assert lost < 1e-6


def test_lower_thresholds_find_their_pairs(spark):
    assert near_dedup.band_shape(0.8) == near_dedup.band_shape(0.95) == (25, 5)
    for threshold in (0.1, 0.3, 0.5, 0.7, 0.79):
        bands, rows = near_dedup.band_shape(threshold)
        assert bands * rows <= near_dedup.REGISTERS and (1 - threshold**rows) ** bands < 1e-4
    docs = []
    for i in range(60):
        text = [f"a{i}x{k}" for k in range(64)]
        docs += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text[:45] + [f"b{i}x{k}" for k in range(19)]))]
    assert 0.5 < _similarity(_bag(docs[0][1]), _bag(docs[1][1])) < 0.53
    rows = near_duplicates(spark.createDataFrame([(d, t, "", 0) for d, t in docs], SCHEMA), threshold=0.5).collect()
    assert sorted(tuple(r) for r in rows) == [(d, d - d % 2, 2) for d, _ in docs]
    with pytest.raises(ValueError, match="similarity 0.02"):
        near_duplicates(spark.createDataFrame([], SCHEMA), threshold=0.02)


def test_components(spark):
    rng = random.Random(1)
    links = [(f"{i:03}".encode(), f"{i + 1:03}".encode()) for i in range(60) if i % 7]
    links += [(b"900", f"{i}".encode()) for i in range(800, 850)] + [(b"x", b"x")]
    rng.shuffle(links)
    frame = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in links], "_a binary, _b binary")
    roots = {bytes(r._node): bytes(r._root) for r in connected_components(frame).collect()}
    assert roots[b"900"] == b"800" and roots[b"849"] == b"800"
    for i in range(60):
        start = i if i % 7 == 1 or i == 0 else (i - 1) // 7 * 7 + 1
        assert roots.get(f"{i:03}".encode(), f"{i:03}".encode()) == f"{start:03}".encode()


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
