from collections import defaultdict

import brute
import pytest
from compare import connect, difference

from embedlab.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from embedlab.llm.queries import ORACLE, QUERIES

SCHEMA = "doc_id long, text string, _digest string, _Nth int"


def _fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def _rows():
    rows = [(i, "Hot Text" if i % 3 == 0 else f"text {i % 40}", "x", i) for i in range(300)]
    rows += [(None, None, "a", 1), (None, "", "b", 2), (7, "ÄB"), (8, "äb"), (9, "Äb")]
    rows += [(298, "hot text"), (299, "text 19"), (299, "TEXT 19"), (None, "lonely"), (500, "x" * 100_000)]
    return [tuple(r) + (None,) * (4 - len(r)) for r in rows]


@pytest.mark.parametrize("support", [0.01, 0.5])
def test_against_brute_force(spark, support):
    rows = _rows()
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[_fold(t)].append(d)
    docs = spark.createDataFrame(rows, SCHEMA)
    result = exact_duplicates(docs, support).collect()
    assert len(result) == len(rows)
    kept = defaultdict(list)
    for r in result:
        members = next(v for k, v in groups.items() if brute.sha(k.encode()) == r.text_sha256)
        assert r.keep_id == max((d for d in members if d is not None), default=None)
        assert r.group_size == len(members)
        if r.kept:
            kept[r.text_sha256].append(r.doc_id)
            assert r.doc_id == r.keep_id
    assert all(len(v) == 1 for v in kept.values()) and len(kept) == len(groups)
    left = drop_exact_duplicates(docs, support)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or -1, _fold(r.text)) for r in left.collect()) == sorted(
        (max((d for d in v if d is not None), default=None) or -1, k) for k, v in groups.items()
    )


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_duplicates(empty).count() == 0
    assert drop_exact_duplicates(empty).count() == 0


def test_query_against_sql(spark, folder):
    name = "op2_exact_dedup"
    assert difference(QUERIES[name](spark, folder), connect(folder), ORACLE[name]) is None


def test_no_python_in_the_plan(spark, folder):
    plan = QUERIES["op2_exact_dedup"](spark, folder)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
