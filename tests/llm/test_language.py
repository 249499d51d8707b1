import itertools

import numpy as np

from embedlab.llm import language
from embedlab.llm.language import forward_backward, identify_languages, train_chain
from embedlab.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, SCORE string"


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(4)
    lengths = np.array([1, 5, 3])
    scores, transitions = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    posterior, pairs = forward_backward(scores, lengths, transitions)
    expected, at = np.zeros((3, 3)), 0
    for n in lengths:
        marginal, mass = np.zeros((n, 3)), 0.0
        links = np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n) + 1):
            value = np.exp(sum(transitions[a, b] for a, b in zip(path, path[1:])) + sum(scores[at + t, s] for t, s in enumerate(path[1:])))
            mass += value
            for t, s in enumerate(path[1:]):
                marginal[t, s] += value
            for a, b in zip(path, path[1:]):
                links[a, b] += value
        assert np.allclose(posterior[at : at + n], marginal / mass)
        expected += links / mass
        at += n
    assert np.allclose(pairs, expected)


def test_long_sequences_do_not_depend_on_blocks():
    rng = np.random.default_rng(6)
    scores, transitions = rng.normal(size=(3000, 2)), rng.normal(size=(2, 2))
    posterior, _ = forward_backward(scores, np.array([3000]), transitions)
    alpha = np.full(2, 0.5)
    for t in range(3000):
        alpha = (alpha @ np.exp(transitions)) * np.exp(scores[t])
        alpha /= alpha.sum()
    assert np.allclose(posterior[-1], alpha)


def test_held_out_accuracy(spark, folder):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op8_language"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    held = [r for r in rows if r.held_out]
    assert held and all(0.0 <= r.score <= 1.0 for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97


def test_code_switched_text_has_switches(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    chain = train_chain(docs)
    parts = {r.lang: r.text for r in docs.where("n_chars > 1000").dropDuplicates(["lang"]).collect()}
    text = parts["en"][:400] + " " + parts["es"][:400]
    row = identify_languages(spark.createDataFrame([(1, text, None, None)], SCHEMA), chain).first()
    assert 1 <= row.n_switches <= 6 and row.score < 0.9


def test_odd_rows(spark, folder):
    odd = [(1, None), (2, ""), (3, "123 !? ²"), (None, "hello"), (4, "a" * 200_000), (4, "x"), (4, "x")]
    rows = [(d, t, "en" if d == 4 else None, "clash") for d, t in odd]
    out = identify_languages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(odd)
    assert [r.lang_pred for r in out[:3]] == ["und"] * 3 and [r.score for r in out[:3]] == [0.0] * 3
    nothing = identify_languages(spark.createDataFrame([(1, "a word", None, "x")], SCHEMA)).first()
    assert (nothing.lang_pred, nothing.score) == ("und", 0.0)
    assert identify_languages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_ids_are_neither_all_in_nor_all_out(spark, monkeypatch):
    monkeypatch.setattr(language, "_fit", lambda parts, languages, epochs: (parts, languages))
    rows = [(i // 40, f"w{chr(97 + i % 26)} x{'abcdefghij'[i // 26 % 10]}{'klmnopqrst'[i // 260]}", "en", "") for i in range(1000)]
    rows += [(6, "same words", "de", "")] * 300 + [(n, "ein wort", "fr", "") for n in (6, 6, 8)]
    parts, languages = train_chain(spark.createDataFrame(rows, SCHEMA), documents_per_language=50)
    count = [sum(label == k for label, _ in parts) for k in range(3)]
    assert languages == ["de", "en", "fr"] and count == [1, 50, 2]
