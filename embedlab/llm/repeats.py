"""Find the windows of texts that occur elsewhere, with little data moved.

Every window of ``length`` items is represented by its smallest sub-window hash, the anchor. Equal
windows have equal anchors, so windows need comparing only where their anchor occurs twice, and
neighbouring windows share an anchor: a *run* stands for about a dozen windows. Runs with equal
content are settled at once, within a text where it is read; only the first copy of each content goes
on to the window level.

``place`` orders occurrences. For word windows it is the document alone, so repeats within one
document do not count; for byte windows it is document and position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlab.llm.rolling import (
    Powers,
    mix,
    prefix_sums,
    range_hashes,
    runs,
    signed,
    window_hashes,
    window_minimum,
)
from embedlab.llm.rows import record_batch, slices

RUN_SCHEMA = "_anchor long, _content long, _key binary, _rank long, _starts array<int>, _width int"
_RUN_ARROW = pa.schema(
    [
        ("_anchor", pa.int64()),
        ("_content", pa.int64()),
        ("_key", pa.binary()),
        ("_rank", pa.int64()),
        ("_starts", pa.list_(pa.int32())),
        ("_width", pa.int32()),
    ]
)
BATCH_BYTES = 1 << 20
SEGMENT_ITEMS = 1 << 20
PLACE_MASK = np.uint64((1 << 21) - 1)


def anchored_runs(
    items: np.ndarray, owner: np.ndarray, length: int, inner: int, powers: Powers
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor place: first and last-plus-one window start, anchor, content hash.

    ``items`` holds several texts one after another and ``owner`` the text of each item.
    """

    empty = np.empty(0, np.int64)
    if len(items) < length:
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    sums = prefix_sums(items, powers)
    hashes = mix(window_hashes(sums, inner, powers))
    # the place in the low bits makes the first of equal hashes the anchor
    marked = (hashes & ~PLACE_MASK) | np.arange(len(hashes), dtype=np.uint64)
    anchors = window_minimum(marked, length - inner + 1) & PLACE_MASK
    place = np.flatnonzero(owner[: len(anchors)] == owner[length - 1 :])
    if len(place) == 0:
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    anchor, text = anchors[place], owner[place]
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut, [len(place)])) - 1
    start, stop = place[first], place[last] + 1
    return start, stop, hashes[anchor[first]], mix(range_hashes(sums, start, stop + length - 1, powers))


def segments(counts: list[int], length: int) -> Iterator[tuple[int, int, int]]:
    """(text, from, to) pieces of at most ``SEGMENT_ITEMS`` window starts, overlapping by a window."""

    for text, count in enumerate(counts):
        for begin in range(0, max(count - length + 1, 0), SEGMENT_ITEMS):
            yield text, begin, min(count, begin + SEGMENT_ITEMS + length - 1)


def run_emitter(to_items: Callable, length: int, inner: int) -> Callable:
    """An Arrow function from (_key, _rank, _text) to runs; ``to_items`` makes a text an array.

    Runs of equal content in one text are one row with all their starts.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, convert = Powers(), to_items()
        for batch in batches:
            for part, texts in slices(batch, "_text", BATCH_BYTES):
                arrays = [convert(text) for text in texts]
                pieces = list(segments([len(a) for a in arrays], length))
                while pieces:
                    taken, size = [], 0
                    while pieces and (not taken or size + pieces[0][2] - pieces[0][1] <= SEGMENT_ITEMS):
                        taken.append(pieces.pop(0))
                        size += taken[-1][2] - taken[-1][1]
                    sizes = np.array([to - begin for _, begin, to in taken])
                    owner = np.repeat(np.arange(len(taken)), sizes)
                    items = np.concatenate([arrays[t][begin:to] for t, begin, to in taken])
                    start, stop, anchor, content = anchored_runs(items, owner, length, inner, powers)
                    piece = owner[start]
                    base = np.cumsum(sizes) - sizes
                    shift = np.array([begin for _, begin, _ in taken]) - base
                    order = np.lexsort((start, content, anchor, piece))
                    start, stop, anchor, content, piece = (
                        x[order] for x in (start, stop, anchor, content, piece)
                    )
                    first, last = runs(piece, anchor, content)
                    places = pa.ListArray.from_arrays(
                        pa.array(np.concatenate((first, [len(start)])), pa.int32()),
                        pa.array(start + shift[piece], pa.int32()),
                    )
                    rows = pa.array(np.array([t for t, _, _ in taken])[piece[first]])
                    yield record_batch(
                        {
                            "_anchor": signed(anchor[first]),
                            "_content": signed(content[first]),
                            "_key": part.column("_key").take(rows),
                            "_rank": part.column("_rank").take(rows),
                            "_starts": places,
                            "_width": (stop - start)[first],
                        },
                        _RUN_ARROW,
                    )

    return emit


def live_runs(runs_table: DataFrame, across_documents: bool) -> DataFrame:
    """Runs whose anchor occurs again: in another document, or anywhere else."""

    counts = runs_table.groupBy("_anchor").agg(
        F.min("_rank").alias("_low"), F.max("_rank").alias("_high"), F.sum(F.size("_starts")).alias("_n")
    )
    again = F.col("_low") < F.col("_high") if across_documents else F.col("_n") > 1
    return runs_table.join(counts.where(again).select("_anchor"), "_anchor")


def spans_by_document(spans: DataFrame) -> DataFrame:
    """One row per document key with its runs as an array; bounded by the text's length."""

    return spans.groupBy("_key").agg(F.collect_list(F.struct("_starts", "_width")).alias("_spans"))


def span_arrays(values: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Starts and stops of each row of an array<struct<_starts, _width>> column; empty for null."""

    flat = values.flatten()
    places = flat.field("_starts")
    counts = np.asarray(pc.list_value_length(places), dtype=np.int64)
    first = places.flatten().to_numpy(zero_copy_only=False)
    last = first + np.repeat(flat.field("_width").to_numpy(zero_copy_only=False), counts)
    inner = np.concatenate(([0], np.cumsum(counts)))
    lengths = np.asarray(pc.fill_null(pc.list_value_length(values), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    edges = list(zip(inner[ends - lengths].tolist(), inner[ends].tolist()))
    return [(first[a:b], last[a:b]) for a, b in edges]


__all__ = [
    "RUN_SCHEMA",
    "anchored_runs",
    "live_runs",
    "run_emitter",
    "runs",
    "span_arrays",
    "spans_by_document",
]
