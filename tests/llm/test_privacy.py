import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from embedlab.llm.privacy import (
    KINDS,
    Island,
    base_spans,
    best_segmentation,
    find_personal_data,
    find_spans,
    log_partition,
    luhn,
    redact,
    redact_documents,
    train_spans,
)
from embedlab.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, spans string, _CLEAN int"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _plain(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            n = sum(c in "0123456789" for c in m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= n <= 19 and luhn("".join(c for c in m[0] if c.isdigit())),
                "phone": 9 <= n <= 15,
            }[kind]
            if good:
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


@pytest.fixture(scope="module")
def weights(spark, folder):
    return train_spans(spark.read.parquet(f"{folder}/documents.parquet"))


def test_patterns_equal_their_plain_form():
    rng = random.Random(0)
    for _ in range(20_000):
        text = "".join(rng.choice("ab.@+-0123 ()@.%é") for _ in range(rng.randrange(0, 40)))
        assert base_spans(text) == _plain(text)


def test_long_runs_take_linear_time():
    for unit in ("a", "1", "1.", "+1", "a@", "1 ", "@", "(1"):
        base_spans(unit * 100_000)


def test_segmentations_by_enumeration():
    rng = np.random.default_rng(3)
    island = Island("+1 (017) 555-77", 0, 15)
    scores = rng.normal(size=(len(island.segments), len(KINDS)))
    log_mass, probability = log_partition(island, scores)
    n, mass, best = len(island.tokens), 0.0, (0.0, [])
    expected = np.zeros_like(scores)

    def walk(at, total, chosen):
        nonlocal mass, best
        if at == n:
            mass += np.exp(total)
            best = max(best, (total, chosen), key=lambda x: x[0])
            for s, k in chosen:
                expected[s, k] += np.exp(total)
            return
        walk(at + 1, total, chosen)
        for (s, (i, j)), k in itertools.product(enumerate(island.segments), range(len(KINDS))):
            if i == at:
                walk(j, total + scores[s, k], [*chosen, (s, k)])

    walk(0, 0.0, [])
    assert np.isclose(log_mass, np.log(mass)) and np.allclose(probability, expected / mass)
    found = [(island.tokens[i][0], island.tokens[j - 1][1], KINDS[k]) for s, k in best[1] for i, j in [island.segments[s]]]
    assert best_segmentation(island, scores) == found


def test_finds_other_spellings_and_leaves_look_alikes(weights):
    for text, kind in [
        ("call (212) 555-0199 now", "phone"), ("tel: 212-555-0199", "phone"),
        ("mail bob.smith at example dot com please", "email"), ("write jane[at]mail[dot]org.", "email"),
    ]:
        assert [s[2] for s in find_spans(text, weights)[1]] == [kind], text
    for text in ["on 2024-01-31 12:30", "number 4111111111111112 no", "1,234,567.89 in all", "we met at home dot", "id 12345678"]:
        assert find_spans(text, weights)[1] == [], text


def test_finds_short_bracketed_addresses_and_upper_case_spellings(weights, spark):
    for text, span in [
        ("from 10[.]0[.]0[.]1 today", "ip:5:19"), ("8[.]8[.]8[.]8 is up", "ip:0:13"),
        ("see 192[.]0[.]2[.]1, please", "ip:4:19"), ("seen at 172[.]16[.]0[.]9", "ip:8:24"),
        ("write jane [AT] mail [DOT] org now", "email:6:30"), ("jane AT mail DOT org", "email:0:20"),
        ("write jane[At]mail[Dot]org.", "email:6:26"),
    ]:
        docs = spark.createDataFrame([(1, text, "", 0)], SCHEMA)
        kind, start, end = span.split(":")
        row = find_personal_data(docs, weights).first()
        assert row.spans == span, text
        assert row.redacted == text[: int(start)] + f"[{kind.upper()}]" + text[int(end) :]
    for text in ["part 300[.]1[.]2[.]3 of it", "call 1[.]2[.]3 now", "we met AT home DOT", "1[.]2[.]3[.]4567 no"]:
        assert find_spans(text, weights)[1] == [], text


def test_bracketed_addresses_of_the_texts_do_not_teach_against_them(spark):
    rows = [(i, f"the host {i % 9 + 1}[.]{i}[.]{i % 7}[.]{i % 251} wrote it", "", 0) for i in range(200)]
    weights = train_spans(spark.createDataFrame(rows, SCHEMA))
    assert [s[2] for s in find_spans("from 10[.]0[.]0[.]1 today", weights)[1]] == ["ip"]


def test_query_keeps_the_patterns_spans(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op9_personal_data"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = _plain(texts[r.doc_id])
        joined = [f"{k}:{s}:{e}" for s, e, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[2] == k for s in base) for k in KINDS]
        assert set(joined) <= set(r.spans.split(","))


def test_odd_rows_and_redaction(spark, weights):
    rows = [(1, None), (2, ""), (None, "a@b.cc"), (4, "é 1.2.3.4 x@y.zz"), (4, "é 1.2.3.4 x@y.zz"), (5, "1 " * 50_000)]
    docs = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], SCHEMA)
    out = find_personal_data(docs, weights).collect()
    assert [r.n_email for r in out] == [0, 0, 1, 1, 1, 0]
    assert out[3].spans == "ip:2:9,email:10:16" and out[3].redacted == "é [IP] [EMAIL]"
    clean = redact_documents(docs, weights)
    assert clean.columns == docs.columns
    assert [r.text for r in clean.collect()][:4] == [None, "", "[EMAIL]", "é [IP] [EMAIL]"]
    assert find_personal_data(docs.limit(0)).count() == 0
    assert redact("abcdef", [(0, 3, "ip"), (2, 4, "card")]) == "[IP]ef"
