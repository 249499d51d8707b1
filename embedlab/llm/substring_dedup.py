"""Substring deduplication on words: Rabin-Karp hashes of fixed-length word windows, counted in Spark."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlab.llm.repeats import (
    BATCH_BYTES,
    RUN_SCHEMA,
    live_runs,
    run_emitter,
    span_arrays,
    spans_by_document,
)
from embedlab.llm.rolling import Powers, WordHashes, covered, mix, prefix_sums, runs, signed, window_hashes
from embedlab.llm.rows import kept, keyed, prepare, record_batch, slices

WINDOW_WORDS = 50


def _hashed_words() -> Callable[[bytes], np.ndarray]:
    hashes = WordHashes()
    return lambda text: hashes.of(text.split())


def _window_emitter(length: int) -> Callable:
    schema = pa.schema(
        [
            ("_hash", pa.int64()),
            ("_guard", pa.int64()),
            ("_key", pa.binary()),
            ("_rank", pa.int64()),
            ("_start", pa.int32()),
        ]
    )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, convert = Powers(), _hashed_words()
        for batch in batches:
            for part, texts in slices(batch, "_text", BATCH_BYTES):
                rows, places, hashes, guards = [], [], [], []
                for row, (text, (first, last)) in enumerate(zip(texts, span_arrays(part.column("_spans")))):
                    words = convert(text)
                    sums = prefix_sums(words, powers)
                    windows = window_hashes(sums, length, powers)
                    guard = window_hashes(prefix_sums(mix(words), powers), length, powers)
                    place = np.flatnonzero(covered(first, last, len(windows)))
                    rows.append(np.full(len(place), row))
                    places.append(place)
                    hashes.append(mix(windows[place]))
                    guards.append(guard[place])
                if rows:
                    take = pa.array(np.concatenate(rows))
                    yield record_batch(
                        {
                            "_hash": signed(np.concatenate(hashes)),
                            "_guard": signed(np.concatenate(guards)),
                            "_key": part.column("_key").take(take),
                            "_rank": part.column("_rank").take(take),
                            "_start": np.concatenate(places),
                        },
                        schema,
                    )

    return emit


def repeated_windows(texts: DataFrame, length: int) -> DataFrame:
    """Ranges of window starts (``_key``, ``_starts``, ``_width``) whose words also start in a
    document of smaller id. ``texts`` comes from ``keyed`` and is read twice."""

    found = kept(
        texts.select("_key", "_rank", "_text").mapInArrow(
            run_emitter(_hashed_words, length, max(1, length // 2)), RUN_SCHEMA
        ),
        "runs",
    )
    live = live_runs(found, across_documents=True)
    contents = live.groupBy("_anchor", "_content").agg(F.min("_rank").alias("_owner"))
    variants = contents.groupBy("_anchor").agg(F.count("*").alias("_variants"))
    judged = kept(
        live.join(contents, ["_anchor", "_content"]).join(variants, "_anchor").select(
            "_key", "_rank", "_starts", "_width", "_owner", "_variants"
        ),
        "judged",
    )
    copies = judged.where("_rank > _owner").select("_key", "_starts", "_width")
    open_runs = judged.where("_rank = _owner and _variants > 1")
    windows = kept(
        texts.select("_key", "_rank", "_text")
        .join(spans_by_document(open_runs), "_key")
        .mapInArrow(
            _window_emitter(length),
            "_hash long, _guard long, _key binary, _rank long, _start int",
        ),
        "windows",
    )
    owners = windows.groupBy("_hash", "_guard").agg(
        F.min("_rank").alias("_low"), F.max("_rank").alias("_high")
    )
    later = (
        windows.join(owners.where("_low < _high"), ["_hash", "_guard"])
        .where("_rank > _low")
        .select("_key", F.array("_start").alias("_starts"), F.lit(1).alias("_width"))
    )
    return copies.unionByName(later)


def _remover(length: int) -> Callable:
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("n_removed", pa.int64()),
            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
            ("kept_text", pa.string()),
            ("kept_sha256", pa.string()),
        ]
    )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_text", BATCH_BYTES):
                out: dict[str, list] = {name: [] for name in schema.names}
                ids = part.column("doc_id").to_pylist()
                for doc, text, (first, last) in zip(ids, texts, span_arrays(part.column("_spans"))):
                    words = text.split()
                    gone = covered(first, last + length - 1, len(words))
                    begin, end = runs(gone)
                    stay = [i for i in range(len(begin)) if not gone[begin[i]]]
                    left = b" ".join(w for i in stay for w in words[begin[i] : end[i]])
                    out["doc_id"].append(doc)
                    out["n_words"].append(len(words))
                    out["n_removed"].append(int(gone.sum()))
                    out["spans"].append(
                        [
                            {"start": int(b), "stop": int(e)}
                            for b, e in zip(begin, end)
                            if gone[b]
                        ]
                    )
                    out["kept_text"].append(left.decode("utf-8"))
                    out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                yield record_batch(out, schema)

    return remove


def remove_repeated_words(docs: DataFrame, length: int = WINDOW_WORDS) -> DataFrame:
    """Cut every word covered by a ``length``-word window that also starts in a document with a
    smaller id. Windows are judged on the input.

    Returns per row of ``docs``: doc_id, n_words, n_removed, spans (maximal removed word ranges),
    kept_text (remaining words joined by one space) and its SHA-256.

    Null and empty texts have no words. A null id ranks after all numbers; rows with the same id
    never remove each other's words. Texts shorter than the window stay whole. Other columns are
    ignored. Rows with a common passage, however many, meet only as partial minima.
    """

    prepare(docs.sparkSession)
    texts = keyed(docs)
    spans = spans_by_document(repeated_windows(texts, length))
    return (
        texts.select("_key", "doc_id", "_text")
        .join(spans, "_key", "left")
        .mapInArrow(
            _remover(length),
            "doc_id long, n_words long, n_removed long, spans array<struct<start:int,stop:int>>, "
            "kept_text string, kept_sha256 string",
        )
    )
