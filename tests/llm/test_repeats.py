import random

import brute
import numpy as np
import pytest

from embedlab.llm import suffix_dedup
from embedlab.llm.queries import QUERIES
from embedlab.llm.substring_dedup import remove_repeated_words
from embedlab.llm.suffix_dedup import longest_factors, remove_repeated_bytes

SCHEMA = "doc_id long, text string, _key string, TEXT2 int"


def _rows(seed):
    rng = random.Random(seed)
    vocabulary = ["ab", "c", "dé", "e\x1cf", "g h", "i"]
    passage = [rng.choice(vocabulary) for _ in range(14)]
    rows = [(None, None), (3, None), (4, ""), (5, " \t\n"), (None, " ".join(passage * 2))]
    for i in range(40):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))]
        at = rng.randrange(len(body) + 1)
        if rng.random() < 0.6:
            body[at:at] = passage[rng.randrange(4) : 14 - rng.randrange(4)]
        rows.append((i // 2 if i % 7 == 0 else i, rng.choice([" ", "\n", "  "]).join(body)))
    return rows + [rows[10], rows[11], (99, "x" * 300), (98, "ab " * 200)]


def _frame(spark, rows):
    return spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("length", [2, 5, 9])
def test_word_windows_against_brute_force(spark, length):
    rows = _rows(length)
    result = remove_repeated_words(_frame(spark, rows), length)
    mine = result.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert _sorted(mine) == _sorted(brute.substring_dedup(rows, length))


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("variants", [0, 1000])
def test_byte_strings_against_brute_force(spark, keep_first, variants, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_VARIANTS", variants)
    rows = _rows(1)
    if keep_first:  # rows equal in id and text have no order
        rows = list(dict.fromkeys(rows))
        rows = [r for i, r in enumerate(rows) if r[0] is not None or i == 4]
        seen = set()
        rows = [r for r in rows if not (r[0] in seen or seen.add(r[0]))]
    result = remove_repeated_bytes(_frame(spark, rows), 20, keep_first)
    mine = result.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert _sorted(mine) == _sorted(brute.suffix_dedup(rows, 20, keep_first))


def test_empty_tables(spark):
    empty = _frame(spark, [])
    assert remove_repeated_words(empty).count() == 0
    assert remove_repeated_bytes(empty).count() == 0


def test_longest_factors_by_definition():
    rng = random.Random(5)
    for _ in range(30):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 60)))
        data = np.frombuffer(text, np.uint8)
        previous, following, source = longest_factors(data, np.arange(len(text)), 64)

        def common(i, j):
            n = 0
            while max(i, j) + n < len(text) and text[i + n] == text[j + n]:
                n += 1
            return n

        for i in range(len(text)):
            assert previous[i] == max((common(i, j) for j in range(i)), default=0)
            assert following[i] == max((common(i, j) for j in range(i + 1, len(text))), default=0)
            if previous[i]:
                assert source[i] < i and common(i, source[i]) == previous[i]


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op4_suffix_dedup"])
def test_queries_against_brute_force(spark, folder, name):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    theirs = brute.substring_dedup(rows, 50) if "op1" in name else brute.suffix_dedup(rows, 400, False)
    assert _sorted(QUERIES[name](spark, folder).collect()) == _sorted(theirs)
    assert any(r[2] for r in theirs)
