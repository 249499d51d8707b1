"""Language identification with a linear-chain conditional random field over the words of a text.

Every word has a score per language from its affixes and character n-grams (hashed) and from word
lists; learned transitions link neighbouring words, so code-switched texts get a language per word.
Forward-backward gives each word's posterior, and a document's languages are their mean.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embedlab.llm.rows import prepare, record_batch, row_key, slices

UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")
FEATURE_BITS = 16
NGRAM_SIZES = (2, 3, 4)
LEXICON_WORDS = 300
DOCUMENTS_PER_LANGUAGE = 500
SEGMENTS_PER_DOCUMENT = 6
SEGMENT_WORDS = 24
BLOCK = 32
BATCH_BYTES = 2 << 20
MIN_SCORE = 0.35


def held_out(id_column: str = "doc_id") -> Column:
    """A quarter of the ids, never used for learning; false for a null id."""

    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str | None) -> list[str]:
    words = WORD.findall(text.lower()) if text else []
    return words if any(c.isalpha() for word in words for c in word) else []


def ngram_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) pairs: hashed n-grams of ``^word$``; those at its ends are its affixes."""

    joined = "".join(f"^{word}$" for word in words).encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(joined, np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    at, features = [], []
    for n in NGRAM_SIZES:
        count = len(codes) - n + 1
        if count <= 0:
            continue
        value = np.full(count, n, np.uint64)
        for k in range(n):
            value = (value ^ codes[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        inside = owner[:count] == owner[n - 1 :]
        at.append(owner[:count][inside])
        features.append((value[inside] >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
    return np.concatenate(at), np.concatenate(features)


@dataclass
class Chain:
    """Languages, hashed feature weights, word-list membership and weights, and transitions."""

    languages: list[str]
    weights: np.ndarray
    lexicon: dict[str, np.ndarray]
    lexicon_weights: np.ndarray
    transitions: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        at, features = ngram_features(words)
        out = np.empty((len(words), len(self.languages)))
        for label in range(len(self.languages)):
            out[:, label] = np.bincount(at, self.weights[features, label], len(words))
        return out + self.lexicon_rows(words) @ self.lexicon_weights

    def lexicon_rows(self, words: list[str]) -> np.ndarray:
        rows = np.zeros((len(words), len(self.languages)))
        for i, word in enumerate(words):
            listed = self.lexicon.get(word)
            if listed is not None:
                rows[i] = listed
        return rows


def forward_backward(
    scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of every word and the expected transition counts, for sequences laid end to end.

    Sequences are cut into blocks. The product of a block's transfer matrices carries the forward
    vector across it from the left and the backward vector from the right, so only the number of
    blocks is walked one by one, and all blocks are worked on at once. The result is exact.
    """

    labels = scores.shape[1]
    transfer = np.exp(transitions - transitions.max())
    blocks = -(-lengths // BLOCK)
    first_block = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    sequence = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(len(scores)) - (np.cumsum(lengths) - lengths)[sequence]
    slot = first_block[sequence] * BLOCK + inside
    emission = np.ones((total * BLOCK, labels))
    emission[slot] = np.exp(scores - scores.max(axis=1, keepdims=True))
    used = np.zeros(total * BLOCK, bool)
    used[slot] = True
    emission = emission.reshape(total, BLOCK, labels)
    used = used.reshape(total, BLOCK)

    product = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    for t in range(BLOCK):
        on = used[:, t]
        step = (product[on] @ transfer) * emission[on, t][:, None, :]
        product[on] = step / step.max(axis=(1, 2), keepdims=True)

    into = np.full((total, labels), 1.0 / labels)
    after = np.full((total, labels), 1.0)
    for k in range(1, int(blocks.max(initial=0))):
        at = (first_block + k)[blocks > k]
        vector = np.einsum("ni,nij->nj", into[at - 1], product[at - 1])
        into[at] = vector / vector.sum(axis=1, keepdims=True)
    for k in range(int(blocks.max(initial=0)) - 2, -1, -1):
        at = (first_block + k)[blocks > k + 1]
        vector = np.einsum("nij,nj->ni", product[at + 1], after[at + 1])
        after[at] = vector / vector.sum(axis=1, keepdims=True)

    before = np.empty((total, BLOCK, labels))
    alpha = into
    for t in range(BLOCK):
        before[:, t] = alpha
        step = (alpha @ transfer) * emission[:, t]
        alpha = np.where(used[:, t][:, None], step / step.sum(axis=1, keepdims=True), alpha)
    behind = np.empty((total, BLOCK, labels))
    beta = after
    for t in range(BLOCK - 1, -1, -1):
        behind[:, t] = beta
        step = (emission[:, t] * beta) @ transfer.T
        beta = np.where(used[:, t][:, None], step / step.sum(axis=1, keepdims=True), beta)

    before = before.reshape(-1, labels)[slot]
    right = (emission * behind).reshape(-1, labels)[slot]
    posterior = (before @ transfer) * right
    mass = posterior.sum(axis=1, keepdims=True)
    pairs = (before / mass).T @ right * transfer
    return posterior / mass, pairs


def _segments(languages_column: str) -> Callable:
    schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text", BATCH_BYTES):
                out: dict[str, list] = {"lang": [], "words": []}
                for lang, text in zip(part.column(languages_column).to_pylist(), texts):
                    words = words_of(text)
                    spread = max(1, len(words) // SEGMENTS_PER_DOCUMENT)
                    for start in range(0, len(words), max(spread, SEGMENT_WORDS)):
                        out["lang"].append(lang)
                        out["words"].append(words[start : start + SEGMENT_WORDS])
                yield record_batch(out, schema)

    return cut


def train_chain(
    docs: DataFrame, documents_per_language: int = DOCUMENTS_PER_LANGUAGE, epochs: int = 6
) -> Chain | None:
    """Fit on up to ``documents_per_language`` labelled documents of each language, those with the
    smallest digests of id and text, and on segments spread over their whole texts. Rows equal in id and
    text count once. Held-out ids are left out.

    Segments of two languages are joined in half of the sequences, so that transitions are seen.
    None when there is nothing to learn from.
    """

    prepare(docs.sparkSession)
    labelled = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()
    ).select("lang", "text", row_key().alias("_key"))
    smallest = Window.partitionBy("lang").orderBy("_key")
    bounds = (
        labelled.select("lang", "_key")
        .distinct()
        .withColumn("_nth", F.row_number().over(smallest))
        .where(F.col("_nth") <= documents_per_language)
        .groupBy("lang")
        .agg(F.max("_key").alias("_last"))
    )
    last = {row["lang"]: bytes(row["_last"]) for row in bounds.collect()}
    if not last:
        return None
    languages = sorted(last)
    limits = F.create_map(*[F.lit(x) for lang in languages for x in (lang, last[lang])])
    sample = labelled.where(F.col("_key") <= limits[F.col("lang")]).dropDuplicates(["lang", "_key"])
    rows = (
        sample.select("lang", "text")
        .mapInArrow(_segments("lang"), "lang string, words array<string>")
        .collect()
    )
    label = {lang: i for i, lang in enumerate(languages)}
    return _fit([(label[r["lang"]], r["words"]) for r in rows if r["words"]], languages, epochs)


def _lexicon(parts: list[tuple[int, list[str]]], labels: int) -> dict[str, np.ndarray]:
    counts = [Counter() for _ in range(labels)]
    for label, words in parts:
        counts[label].update(words)
    lists: dict[str, np.ndarray] = {}
    for label, counter in enumerate(counts):
        for word, _ in sorted(counter.items(), key=lambda item: (-item[1], item[0]))[:LEXICON_WORDS]:
            lists.setdefault(word, np.zeros(labels))[label] = 1.0
    return lists


def _fit(parts: list[tuple[int, list[str]]], languages: list[str], epochs: int) -> Chain:
    labels = len(languages)
    rng = np.random.default_rng(7)
    parts = sorted(parts)
    chain = Chain(
        languages,
        np.zeros((1 << FEATURE_BITS, labels)),
        _lexicon(parts, labels),
        np.zeros((labels, labels)),
        np.zeros((labels, labels)),
    )
    state = [np.full_like(x, 1e-3) for x in (chain.weights, chain.lexicon_weights, chain.transitions)]
    for _ in range(epochs):
        order = rng.permutation(len(parts))
        pieces = iter(order)
        sequences = []
        for i in pieces:
            j = next(pieces, None) if rng.random() < 0.5 else None
            sequences.append([parts[i]] if j is None else [parts[i], parts[j]])
        for at in range(0, len(sequences), 128):
            batch = sequences[at : at + 128]
            words = [w for sequence in batch for _, part in sequence for w in part]
            truth = np.concatenate([np.full(len(p), k) for s in batch for k, p in s])
            lengths = np.array([sum(len(p) for _, p in s) for s in batch])
            posterior, pairs = forward_backward(chain.scores(words), lengths, chain.transitions)
            observed = np.zeros_like(posterior)
            observed[np.arange(len(truth)), truth] = 1.0
            error = (observed - posterior) / len(words)
            starts = np.cumsum(lengths) - lengths
            inner = np.ones(len(truth), bool)
            inner[starts] = False
            seen = np.zeros_like(pairs)
            np.add.at(seen, (truth[np.flatnonzero(inner) - 1], truth[inner]), 1.0)
            # the uniform start counts as a transition into the first word
            np.add.at(seen.T, truth[starts], 1.0 / labels)
            owner, features = ngram_features(words)
            slope = np.stack(
                [np.bincount(features, error[owner, k], 1 << FEATURE_BITS) for k in range(labels)], axis=1
            )
            slopes = (
                slope - 1e-7 * chain.weights,
                chain.lexicon_rows(words).T @ error,
                (seen - pairs) / len(words) - 1e-5 * chain.transitions,
            )
            values = (chain.weights, chain.lexicon_weights, chain.transitions)
            for value, gradient, past, rate in zip(values, slopes, state, (0.3, 0.3, 0.1)):
                past += gradient * gradient
                value += rate * gradient / np.sqrt(past)
    return chain


def label_texts(
    chain: Chain | None, texts: list[str | None]
) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, number of words and of language switches of every text."""

    lists = [words_of(text) for text in texts]
    lengths = np.array([len(words) for words in lists], dtype=np.int64)
    names, scores = [UNDETERMINED] * len(lists), np.zeros(len(lists))
    switches = np.zeros(len(lists), np.int64)
    filled = np.flatnonzero(lengths)
    if chain is None or len(filled) == 0:
        return names, scores, lengths, switches
    distinct = {w: i for i, w in enumerate(dict.fromkeys(w for x in lists for w in x))}
    emission = chain.scores(list(distinct))
    flat = np.fromiter((distinct[w] for x in lists for w in x), np.int64, int(lengths.sum()))
    posterior, _ = forward_backward(emission[flat], lengths[filled], chain.transitions)
    starts = (np.cumsum(lengths) - lengths)[filled]
    mean = np.add.reduceat(posterior, starts, axis=0) / lengths[filled][:, None]
    best = mean.argmax(axis=1)
    likely = posterior.argmax(axis=1)
    change = np.concatenate((likely[1:] != likely[:-1], [False]))
    change[(starts[1:] - 1)] = False
    switches[filled] = np.add.reduceat(change, starts)
    scores[filled] = np.clip(mean[np.arange(len(best)), best], 0.0, 1.0)
    for i, k in zip(filled.tolist(), best.tolist()):
        names[i] = chain.languages[k]
    return names, scores, lengths, switches


def _labeller(broadcast) -> Callable:
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("held_out", pa.bool_()),
            ("lang_pred", pa.string()),
            ("score", pa.float64()),
            ("n_words", pa.int64()),
            ("n_switches", pa.int64()),
        ]
    )

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text", BATCH_BYTES):
                names, scores, lengths, switches = label_texts(broadcast.value, texts)
                yield record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "held_out": part.column("held_out"),
                        "lang_pred": names,
                        "score": scores,
                        "n_words": lengths,
                        "n_switches": switches,
                    },
                    schema,
                )

    return label


def identify_languages(docs: DataFrame, chain: Chain | None = None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, n_words, n_switches (language changes inside).

    Learns from ``docs`` unless a trained ``chain`` is given; only texts are used to predict. A null
    text, or one without a letter, is ``und`` with score 0, and so is every text when there is nothing
    to learn from. Repeated rows get repeated results; null ids are predicted but not learned from;
    other columns are ignored. Whole texts are labelled, in memory proportional to one text.
    """

    spark = docs.sparkSession
    prepare(spark)
    chain = chain or train_chain(docs)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"
    ).mapInArrow(
        _labeller(spark.sparkContext.broadcast(chain)),
        "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long",
    )


def keep_identified(docs: DataFrame, chain: Chain | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is determined with at least ``min_score``; the others (no
    letters, or no language clearly ahead) go. All columns stay as they are, whatever their names.

    Without anything to learn from all rows stay that have a letter.
    """

    spark = docs.sparkSession
    prepare(spark)
    chain = chain or train_chain(docs)
    broadcast = spark.sparkContext.broadcast(chain)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text", BATCH_BYTES):
                if broadcast.value is None:
                    stay = [bool(words_of(t)) for t in texts]
                else:
                    names, scores, _, _ = label_texts(broadcast.value, texts)
                    stay = [n != UNDETERMINED and s >= min_score for n, s in zip(names, scores)]
                yield part.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
