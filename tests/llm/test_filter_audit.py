import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from compare import connect, difference

from embedlab.llm import sketch
from embedlab.llm.filter_audit import audit_filters
from embedlab.llm.queries import ORACLE, QUERIES

DOCS = "doc_id long, text string, lang string, part string, _rank int, mask int"
LABELS = "doc_id long, quality int, toxic int, part string"


def _rows():
    words = [f"word{i}" for i in range(300)]
    long, dull = " ".join(words), " ".join(words[:60] * 5)
    rows = [(i, long, "en") for i in range(40)]  # a hot text
    rows += [(i, dull + (" #" if i % 2 else ""), ["en", None, "", "de"][i % 4]) for i in range(40, 60)]
    rows += [(60, None, "en"), (61, "", "en"), (None, "", "en"), (None, "lonely", "fr"), (None, "lonely", "fr")]
    rows += [(62, "twice", "de"), (62, "twice", "de"), (63, "twice", "de"), (64, "\x0b \t", None), (65, "É" * 50 + "AB", "x")]
    rows += [(66, "a b " * 120_000, "en"), (67, "CAPS " * 210, "en"), (67, long, "de")]
    return rows


def _labels():
    return [(i, i % 3 % 2, int(i % 5 == 0)) for i in range(70)] + [(5, None, None), (None, 1, 1), (6, 1, 1), (6, 0, 0)]


def _brute(rows, labels):
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    big = 1 << 63
    first = {}
    for d, t, _ in rows:
        first[t or ""] = min(first.get(t or "", big), big - 1 if d is None else d)
    parts = {}
    for d, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": (big - 1 if d is None else d) > first[t],
        }
        parts.setdefault(lang or "", []).append(({f for f in failed if failed[f]}, d in good, d in toxic))
    out = {}
    for part, docs in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = list(docs)
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[0]]
                shapley[f] += len(removed)
                left = [x for x in left if f not in x[0]]
                out[part, "".join(order), step] = [
                    len(left),
                    len(removed),
                    sum(f in x[0] for x in docs) - len(removed),
                    sum(x[0] == {f} for x in docs),
                    sum(x[1] for x in removed),
                    sum(x[2] for x in removed),
                ]
        for key in [k for k in out if k[0] == part]:
            out[key].append(shapley[key[1][key[2] - 1]])
    return out


def test_against_brute_force(spark):
    rows, labels = _rows(), _labels()
    docs = spark.createDataFrame([(*r, "p", 1, 2) for r in rows], DOCS).repartition(5)
    audit = audit_filters(docs, spark.createDataFrame([(*r, "q") for r in labels], LABELS)).collect()
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in audit} == _brute(rows, labels)
    assert len(audit) == 600 * len({lang or "" for *_, lang in rows})


def test_empty(spark):
    empty, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit_filters(empty, labels).count() == 0
    docs = spark.createDataFrame([(1, "a", "en", None, 0, 0)], DOCS)
    assert audit_filters(docs, labels).where("good_lost + toxic_lost > 0").count() == 0


def test_full_filter_changes_nothing(spark, folder):
    """With a filter far too small every text is a possible repeat, and the result is the same."""

    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    small = sorted(audit_filters(docs, labels, max_cells=16).collect())
    assert small == sorted(QUERIES["op13_filter_audit"](spark, folder).collect())


def test_filter_never_clears_a_repeat(spark):
    df = spark.range(4000).selectExpr("xxhash64(id % 3000) AS _h1", "xxhash64(id % 3000, 13) AS _h2").repartition(7)
    packed = sketch.counting_filter(df, sketch.CHUNK_CELLS)
    first, second = (np.array(c) for c in zip(*[(r._h1, r._h2) for r in df.collect()]))
    least = sketch.least_count(packed, first, second)
    assert (least >= 1).all()
    repeated = np.isin(first, [h for h, n in Counter(first.tolist()).items() if n > 1])
    assert (least[repeated] == 2).all() and (least[~repeated] == 1).mean() > 0.9


@pytest.mark.parametrize("rows, cells", [(0, 1 << 16), (4096, 1 << 16), (5000, 1 << 17), (1 << 40, 1 << 28)])
def test_filter_size_is_bounded(rows, cells):
    assert sketch.cells_for(rows) == cells


def test_query_against_sql(spark, folder):
    name = "op13_filter_audit"
    assert difference(QUERIES[name](spark, folder), connect(folder), ORACLE[name]) is None
