import random
import zlib
from itertools import product

import numpy as np
import pytest

from embedlab.llm import deobfuscation as D
from embedlab.llm.toxicity import character_model, features, score_toxicity
from embedlab.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, score double, _key int"
LABELS = "doc_id long, quality int, toxic int, text string"
CLEAN = "river mountain garden window letter number summer winter people kitchen morning evening".split()
RUDE = "loser idiot scum moron".split()


def _corpus(n=400):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(CLEAN) for _ in range(30)]
        if toxic:
            words.insert(rng.randrange(30), rng.choice(RUDE))
        rows.append((i, " ".join(words).capitalize() + ".", "en"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def _frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in rows], SCHEMA).repartition(4)
    return docs, spark.createDataFrame([(*r, "t") for r in labels], LABELS)


@pytest.fixture(scope="module")
def model():
    text = [t for _, t, _ in _corpus()[0]]
    return D.CharacterModel(np.bincount(D.count_cells(text), minlength=D.CELLS))


def _score_of(model, text):
    state, total = (D.BOUNDARY,), 0.0
    for code in [*D.symbols(text).tolist(), D.BOUNDARY]:
        if code == D.BOUNDARY == state[-1]:
            continue
        total += model.cost(state, code)
        state = (*state, code)[-3:]
    return total


@pytest.mark.parametrize(
    "span, spaced",
    [("1d10t", False), ("l00ser", False), ("scuuum", False), ("m 0 r 0 n", True), ("$$c-u-m", True), ("4", False), ("", False)],
)
def test_viterbi_against_all_readings(model, span, spaced):
    steps = D.lattice(span, spaced)
    best = max(
        (sum(c for _, c in path) + _score_of(model, "".join(t for t, _ in path)), "".join(t for t, _ in path))
        for path in product(*steps)
    )
    text, value = D.best_reading(model, steps)
    assert abs(value - best[0]) < 1e-4 and abs(_score_of(model, text) - _score_of(model, best[1])) < 20


@pytest.mark.parametrize(
    "disguised, plain",
    [
        ("You L0SER!", "you loser!"),
        ("such an 1d10t.", "such an idiot."),
        ("m o r o n", "moron"),
        ("s.c.u.m, really", "scum, really"),
        ("looooser", "loser"),
        ("$cum", "scum"),
        ("nothing to see", "nothing to see"),
        ("call 12345 or 10:30", "call 12345 or 10:30"),
        ("", ""),
    ],
)
def test_restoring(model, disguised, plain):
    assert D.Restorer(model)(disguised) == plain


def test_long_spans_stay_linear(model):
    restorer = D.Restorer(model)
    assert len(restorer("a b c d " * 50_000)) > 0
    assert restorer("x" * 300_000) in ("x", "xx", "x" * 300_000)
    assert restorer("1 2 3 " * 50_000) == "1 2 3 " * 50_000


def test_planted_disguises(spark):
    rows, labels = _corpus()
    disguises = ["l0ser", "1d10t", "s c u m", "m-o-r-o-n", "loooser", "idi0t", "$cum"]
    planted = [(10_000 + i, f"the river {d} and garden", "en") for i, d in enumerate(disguises)]
    innocent = [(20_000 + i, f"the river {c} and garden 4 u 2 see", "en") for i, c in enumerate(CLEAN)]
    docs, known = _frames(spark, rows + planted + innocent, labels)
    got = {r.doc_id: r for r in score_toxicity(docs, known).collect()}
    assert len(got) == len(rows) + len(planted) + len(innocent)
    assert [r.restored for d, *_ in planted if not (r := got[d]).predicted] == []
    assert all(got[d].predicted == 0 for d, *_ in innocent)
    truth = dict((d, x) for d, _, x in labels)
    for d, x in truth.items():
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert got[d].predicted == x == int(got[d].score >= 0.3)


def test_held_out_labels_teach_nothing(spark):
    rows, labels = _corpus(200)
    turned = [(d, q, 1 - x if zlib.crc32(str(d).encode()) % 4 == 2 else x) for d, q, x in labels]
    a, b = (sorted(score_toxicity(*_frames(spark, rows, x)).drop("restored").collect()) for x in (labels, turned))
    assert a == b


def test_edges(spark):
    rows, labels = _corpus(100)
    odd = [(None, None, None), (None, "loser", "en"), (7, "", "en"), (7, "", "en"), (8, "é" * 200_000, "fr"), (9, "😀".encode("utf-16", "surrogatepass").decode("utf-16"), "x")]
    labels += [(3, None, None), (None, 1, 1), (0, 1, 0)]
    got = score_toxicity(*_frames(spark, rows + odd, labels)).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    docs, _ = _frames(spark, rows, labels)
    nothing = spark.createDataFrame([], LABELS)
    assert {r.score for r in score_toxicity(docs, nothing).collect()} == {0.0}
    one_kind = spark.createDataFrame([(i, 1, 0, "") for i in range(50)], LABELS)
    assert max(r.predicted for r in score_toxicity(docs, one_kind).collect()) == 0
    assert score_toxicity(docs.limit(0), nothing).count() == 0


def test_counts_cover_all_texts(spark):
    rows, _ = _corpus(50)
    docs, _ = _frames(spark, rows, [(1, 1, 1)])
    one = D.CharacterModel(np.bincount(np.concatenate([D.count_cells([t]) for _, t, _ in rows]), minlength=D.CELLS))
    all_ = character_model(docs)
    # windows across two documents are the only difference
    assert np.abs(np.exp(one.log[3]) - np.exp(all_.log[3])).max() < 0.5
    assert features("Größe loser") == {"w:Größe", "w:loser", "s:Größe", "s:loser"}


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1")
    scored = QUERIES["op12_toxicity"](spark, folder)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic)
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.03 * len(rows)
