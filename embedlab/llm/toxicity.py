"""Toxicity of texts: disguised words are restored, then a linear model scores the restored words.

The character model counts windows of all texts. The classifier learns from a bounded sample of labelled
documents that are not held out: it picks the words and beginnings of words that tell the labels apart
(log-likelihood ratio) and fits a logistic regression on them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embedlab.llm.deobfuscation import CELLS, CharacterModel, Restorer, cell_counter
from embedlab.llm.language import held_out
from embedlab.llm.rows import kept, prepare, record_batch, row_key, slices

TOXIC_ROWS = 3000
CLEAN_ROWS = 6000
FEATURES = 4000
#: least log-likelihood ratio of a feature; about one in 16,000 features without a bearing reaches it
CONTRAST = 16.0
STEM_LENGTHS = (5, 6)
THRESHOLD = 0.3
BATCH_BYTES = 1 << 20
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Classifier:
    """Weights of words (``w:``) and beginnings of words (``s:``), and the bias."""

    weights: dict[str, float]
    bias: float

    def score(self, restored: str) -> float:
        total = self.bias + sum(self.weights.get(f, 0.0) for f in features(restored))
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -60, 60))))


def features(restored: str) -> set[str]:
    """Distinct words of a restored text and their first five and six letters."""

    words = set(_LETTERS.findall(restored))
    out = {"w:" + w for w in words}
    for size in STEM_LENGTHS:
        out.update("s:" + w[:size] for w in words if len(w) >= size)
    return out


def character_model(docs: DataFrame) -> CharacterModel:
    """Counted over all texts; at most ``CELLS`` numbers reach the driver."""

    prepare(docs.sparkSession)
    counts = np.zeros(CELLS, np.int64)
    cells = docs.select("text").mapInArrow(cell_counter, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for batch in cells.toArrow().to_batches():
        counts[batch.column("cell").to_numpy()] = batch.column("n").to_numpy()
    return CharacterModel(counts)


def _sample(docs: DataFrame, labels: DataFrame, toxic_rows: int, clean_rows: int) -> DataFrame:
    """``text, toxic, weight`` of the labelled documents with the smallest digests, exactly bounded.

    ``weight`` restores the shares of the labels. Rows equal in id and text count once.
    """

    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    rows = docs.where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("_key"))
    labelled = kept(rows.join(known, "doc_id").select("_key", "toxic").distinct(), "labelled")
    sizes = labelled.groupBy("toxic").agg(F.count("*").alias("_n"))
    best = Window.partitionBy("toxic").orderBy("_key")
    bound = F.when(F.col("toxic") == 1, toxic_rows).otherwise(clean_rows)
    # first within a few thousand shares of the keys, so that no label is ranked in one task
    share = Window.partitionBy("toxic", "_share").orderBy("_key")
    chosen = (
        labelled.withColumn("_share", F.pmod(F.hash("_key"), F.lit(256)))
        .withColumn("_nth", F.row_number().over(share))
        .where(F.col("_nth") <= bound)
        .withColumn("_nth", F.row_number().over(best))
        .where(F.col("_nth") <= bound)
        .join(F.broadcast(sizes), "toxic")
        .select("_key", "toxic", (F.col("_n") / F.least(F.col("_n"), bound)).alias("weight"))
    )
    # at most toxic_rows + clean_rows rows
    chosen = F.broadcast(kept(chosen, "chosen"))
    texts = docs.select(row_key().alias("_key"), F.col("text").alias("text")).join(chosen, "_key")
    return kept(texts.dropDuplicates(["_key"]).select("text", "toxic", "weight"), "sample")


def _restored(model, indexed) -> Callable:
    """Arrow function from (text, toxic, weight): with ``indexed`` the numbers of known features, else their names."""

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.value)
        kind = pa.list_(pa.string() if indexed is None else pa.int32())
        number = None if indexed is None else indexed.value
        for batch in batches:
            found = [features(restorer(t)) for t in batch.column("text").to_pylist()]
            if number is not None:
                found = [[number[f] for f in names if f in number] for names in found]
            else:
                found = [list(names) for names in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, kind), batch.column("toxic"), batch.column("weight")], names=["features", "toxic", "weight"]
            )

    return restore


def _contrast(sample: DataFrame, model, limit: int) -> list[str]:
    """The features whose document counts differ most between the labels."""

    seen = sample.mapInArrow(_restored(model, None), "features array<string>, toxic int, weight double")
    counted = seen.select(F.explode("features").alias("f"), "toxic").groupBy("f").agg(
        F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b")
    )
    totals = {r["toxic"]: float(r["count"]) for r in sample.groupBy("toxic").count().collect()}
    here, there = totals.get(1, 0.0), totals.get(0, 0.0)
    if not here or not there:
        return []
    a, b = F.col("a"), F.col("b")
    expected = (a + b) / (here + there)

    def part(x, e):
        return F.when(x > 0, x * F.log(x / e)).otherwise(0.0)

    ratio = part(a, expected * here) + part(b, expected * there) + part(here - a, (1 - expected) * here) + part(
        there - b, (1 - expected) * there
    )
    scored = counted.where("a + b >= 3").withColumn("g", F.round(2 * ratio, 6)).where(F.col("g") >= CONTRAST)
    best = scored.orderBy(F.desc("g"), "f").limit(limit)
    return [r["f"] for r in best.collect()]


def _fit(rows: list, names: list[str], steps: int = 300, penalty: float = 2e-4) -> Classifier:
    """Weighted logistic regression by accelerated gradient steps."""

    truth = np.array([r["toxic"] for r in rows], float)
    weight = np.array([r["weight"] for r in rows], float)
    weight /= weight.sum()
    sizes = np.array([len(r["features"]) for r in rows])
    column = np.concatenate([np.asarray(r["features"], np.int64) for r in rows]) if len(rows) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)
    rate_of_toxic = float(np.clip((weight * truth).sum(), 1e-4, 1 - 1e-4))
    w, bias = np.zeros(len(names)), np.log(rate_of_toxic / (1 - rate_of_toxic))
    past_w, past_b, seen_w, seen_b = np.zeros_like(w), 0.0, np.full_like(w, 1e-10), 1e-10
    for _ in range(steps if len(names) else 0):
        margin = np.bincount(row, w[column], len(rows)) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - truth)
        slope_w, slope_b = np.bincount(column, error[row], len(names)) + penalty * w / 10, error.sum()
        past_w, past_b = 0.9 * past_w + 0.1 * slope_w, 0.9 * past_b + 0.1 * slope_b
        seen_w, seen_b = 0.99 * seen_w + 0.01 * slope_w**2, 0.99 * seen_b + 0.01 * slope_b**2
        w -= 0.03 * past_w / np.sqrt(seen_w + 1e-12)
        bias -= 0.03 * past_b / np.sqrt(seen_b + 1e-12)
    return Classifier({name: float(x) for name, x in zip(names, w)}, float(bias))


def learn_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    model: CharacterModel,
    toxic_rows: int = TOXIC_ROWS,
    clean_rows: int = CLEAN_ROWS,
    limit: int = FEATURES,
) -> Classifier | None:
    """Learns from at most ``toxic_rows`` and ``clean_rows`` documents of each label; None without labels.

    A document is toxic if any label row of its id says so; null labels and null ids are not used.
    """

    prepare(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    sample = _sample(docs, labels, toxic_rows, clean_rows)
    shared = context.broadcast(model)
    names = sorted(_contrast(sample, shared, limit))
    numbers = context.broadcast({name: i for i, name in enumerate(names)})
    rows = sample.mapInArrow(_restored(shared, numbers), "features array<int>, toxic int, weight double").collect()
    return _fit(sorted(rows, key=lambda r: (r["toxic"], r["features"])), names) if rows else None


def _scorer(model, classifier) -> Callable:
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("held_out", pa.bool_()),
            ("score", pa.float64()),
            ("predicted", pa.int32()),
            ("restored", pa.string()),
        ]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, judge = Restorer(model.value), classifier.value
        for batch in batches:
            for part, texts in slices(batch, "text", BATCH_BYTES):
                restored = [restorer(t) for t in texts]
                scores = [judge.score(t) if judge else 0.0 for t in restored]
                yield record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "held_out": part.column("held_out"),
                        "score": scores,
                        "predicted": [int(s >= THRESHOLD) for s in scores],
                        "restored": restored,
                    },
                    schema,
                )

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, restored (the lower-cased text with its
    disguised words restored).

    A null text counts as empty; an empty text gets the score of the bias. Without any usable label every score is
    0. Rows that are equal get equal scores; other columns are not used. An empty table gives no rows.
    """

    prepare(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    model = character_model(docs)
    classifier = context.broadcast(learn_toxicity(docs, labels, model))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out().alias("held_out"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(
        _scorer(context.broadcast(model), classifier),
        "doc_id long, held_out boolean, score double, predicted int, restored string",
    )
