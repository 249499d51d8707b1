import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import connect, difference

from embedlab.llm.collocations import collocations
from embedlab.llm.phrase_tokens import Block, blocks, fold
from embedlab.llm.queries import ORACLE, QUERIES

SCHEMA = "doc_id long, text string, lang string, phrase string, f long, _k int"


def _brute(rows, top, least, percent=80):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang or "und", Counter())[tuple(words[i : i + m])] += 1
    out = set()
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        hidden = {
            p[i : i + m]
            for p, big in found.items()
            for m in range(2, len(p))
            for i in range(len(p) - m + 1)
            if 100 * big >= percent * f[p[i : i + m]]
        }
        scored = []
        for p, a in found.items():
            if p not in hidden:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def _rows():
    rng = random.Random(3)
    phrases = ["new york city hall", "ice cream", "at the end of", "ÄÖ ä\U0001f600", "x\x01y z", "same same same", "zz qq", "qq zz"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(0, 25)):
            words += [rng.choice(phrases)] if rng.random() < 0.5 else [rng.choice("abcde") * rng.randint(1, 2)]
        text = "".join(w + rng.choice([" ", "  ", "\t", ". ", "\n", ",", "\r\n", " "]) for w in words)
        rows.append((i, text.upper() if i % 7 == 0 else text, ["en", "en", "de", None, "und"][i % 5]))
    rows += [(None, None, "en"), (1, "", "fr"), (2, "...", "fr"), (3, "ice cream " * 40, "xx"), (3, "ice cream " * 40, "xx")]
    rows += [(9, "one two three four five six seven " * 300, "long")]  # one piece of many blocks
    return rows


@pytest.mark.parametrize(
    "top, least, block, size",
    [(3, 3, 40, 16), (2000, 2, 300, 500), (1, 8, 1 << 20, 4)],
)
def test_against_brute_force(spark, top, least, block, size):
    rows = _rows()
    docs = spark.createDataFrame([(*r, "p", 1, 2) for r in rows], SCHEMA).repartition(4)
    found = collocations(docs, top, least, block_bytes=block, round_size=size).collect()
    assert len(found) == len({tuple(r) for r in found})
    assert {tuple(r) for r in found} == _brute(rows, top, least)


def test_bounded_rounds_change_nothing(spark):
    docs = spark.createDataFrame([(*r, "p", 1, 2) for r in _rows()], SCHEMA)
    few = collocations(docs, 20, 5, round_bound=60)
    assert sorted(few.collect()) == sorted(collocations(docs, 20, 5).collect())


def test_empty(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, None, None, "", 1, 1), (2, " ", "en", "", 1, 1)], SCHEMA)
    assert collocations(docs).count() == 0


@pytest.mark.parametrize("limit", [1, 7, 30, 200, 10_000])
def test_blocks_count_every_window_once(limit):
    rng = random.Random(limit)
    text = "".join(rng.choice(["ab ", "c ", "longer-word ", "d\n", "  ", "\n\n", "é ", "f."]) for _ in range(400)) + "x" * 300 + " end of it"
    data = fold(text.encode())
    whole = Block(data, 0)
    for m in range(1, 5):
        wanted, got = Counter(), Counter()
        for block, total in [(whole, wanted)] + [(Block(*b), got) for b in blocks(data, limit)]:
            phrases, counts = block.count(np.flatnonzero(block.valid(m)), m)
            total.update(dict(zip(phrases.to_pylist(), counts.tolist())))
        assert got == wanted


def test_query_against_sql(spark, folder):
    name = "op11_collocations"
    assert difference(QUERIES[name](spark, folder), connect(folder), ORACLE[name]) is None
