"""Best-fit packing of documents into fixed-length sequences by the sum-of-squares rule.

An item goes where the sum, over gap sizes, of the squared number of open sequences with that gap
becomes smallest. Items are dealt into groups of bounded size that are packed in parallel, largest
first; what the groups leave unfilled is packed once more, together.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlab.llm.bpe import BATCH_BYTES, shared_encoder, vocabulary_path
from embedlab.llm.rows import kept, prepare, record_batch, slices

SEQUENCE_TOKENS = 2048
GROUP_ITEMS = 4096


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, placed in the given order; sizes are 1 to ``capacity``.

    With ``n[g]`` open bins of gap g, an item of size s put into a bin of gap g changes the sum of
    squares by -(2 n[g] - 1) + (2 n[g-s] + 1); full bins do not count. Opening a bin adds
    2 n[capacity-s] + 1. The smallest change wins, then the tightest gap.
    """

    counts = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    bins = np.empty(len(sizes), np.int64)
    offsets = np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        after = 2 * counts[: capacity - size + 1] + 1
        after[0] = 0
        change = after + 1 - 2 * counts[size:]
        change[counts[size:] == 0] = np.iinfo(np.int64).max
        change[-1] = after[-1]  # gap = capacity: a new bin
        gap = size + int(np.argmin(change))
        if gap == capacity:
            chosen = len(fill)
            fill.append(0)
        else:
            chosen = open_bins[gap].pop()
            counts[gap] -= 1
        bins[i], offsets[i] = chosen, fill[chosen]
        fill[chosen] += size
        left = gap - size
        if left:
            counts[left] += 1
            open_bins[left].append(chosen)
    return bins, offsets


def _pieces(path: str, capacity: int) -> Callable:
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("piece", pa.int32()),
            ("start", pa.int64()),
            ("length", pa.int64()),
            ("ids_crc32", pa.int64()),
        ]
    )
    end = np.zeros(1, "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        for batch in batches:
            for part, texts in slices(batch, "_text", BATCH_BYTES):
                out: dict[str, list] = {name: [] for name in schema.names}
                for doc, packed in zip(part.column("doc_id").to_pylist(), encoder.encode_all(texts)):
                    packed += end
                    for piece, at in enumerate(range(0, len(packed), 4 * capacity)):
                        ids = packed[at : at + 4 * capacity]
                        out["doc_id"].append(doc)
                        out["piece"].append(piece)
                        out["start"].append(at // 4)
                        out["length"].append(len(ids) // 4)
                        out["ids_crc32"].append(zlib.crc32(ids))
                yield record_batch(out, schema)

    return cut


def _pack_group(capacity: int) -> Callable:
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_size", "_item"], ascending=[False, True], kind="stable")
        bins, offsets = sum_of_squares(group["_size"].to_numpy(), capacity)
        return pd.DataFrame(
            {
                "_item": group["_item"].to_numpy(),
                "_size": group["_size"].to_numpy(),
                "_group": group["_group"].to_numpy(),
                "_bin": bins,
                "_offset": offsets,
            }
        )

    return pack


def _packed(items: DataFrame, n: int, capacity: int) -> DataFrame:
    """``_item, _size, _group, _bin, _offset`` for items dealt evenly into groups by their number."""

    groups = max(1, -(-n // GROUP_ITEMS))
    return (
        items.withColumn("_group", F.pmod(F.xxhash64("_item"), F.lit(groups)))
        .groupBy("_group")
        .applyInPandas(
            _pack_group(capacity), "_item long, _size long, _group long, _bin long, _offset long"
        )
    )


def pack_items(items: DataFrame, capacity: int) -> DataFrame:
    """``_item`` (unique), ``_size`` (1 to capacity) to ``_item, sequence_id, offset``.

    Bins that the groups leave open go through a second packing as items of the size of their
    filling. Every table between is bounded by the number of items, and only counts reach the driver.
    """

    n = items.count()
    first = kept(_packed(items, n, capacity), "packed")
    bins = first.groupBy("_group", "_bin").agg(F.sum("_size").alias("_fill"))
    opened = kept(
        bins.where(F.col("_fill") < capacity).select(
            F.monotonically_increasing_id().alias("_item"), F.col("_fill").alias("_size"), "_group", "_bin"
        ),
        "open_bins",
    )
    second = _packed(opened.select("_item", "_size"), opened.count(), capacity)
    moved = opened.select("_item", F.col("_group").alias("_from"), F.col("_bin").alias("_part")).join(
        second.withColumnsRenamed({"_group": "_group2", "_bin": "_bin2", "_offset": "_shift"}), "_item"
    )
    # even numbers for bins filled at once, odd for the repacked ones
    number = lambda group, bin_: (F.col(group) * F.lit(GROUP_ITEMS * 64) + F.col(bin_)) * 2
    return first.join(
        moved.select(
            F.col("_from").alias("_group"),
            F.col("_part").alias("_bin"),
            (number("_group2", "_bin2") + 1).alias("_sequence"),
            "_shift",
        ),
        ["_group", "_bin"],
        "left",
    ).select(
        "_item",
        F.coalesce("_sequence", number("_group", "_bin")).alias("sequence_id"),
        (F.col("_offset") + F.coalesce("_shift", F.lit(0))).alias("offset"),
    )


def pack_documents(
    docs: DataFrame, capacity: int = SEQUENCE_TOKENS, path: str | None = None
) -> DataFrame:
    """Pieces of documents placed into sequences of at most ``capacity`` tokens.

    A document is its ids followed by id 0. Only documents longer than a sequence are cut, into full
    pieces and a rest. Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    (gapless from 0 within a sequence).

    A null or empty text is the single id 0. Null and repeated ids are packed like others, each row
    for itself. Other columns are ignored; an empty table gives no pieces.
    """

    prepare(docs.sparkSession)
    pieces = kept(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("text"), F.lit("")).alias("_text"),
        ).mapInArrow(
            _pieces(path or vocabulary_path(), capacity),
            "doc_id long, piece int, start long, length long, ids_crc32 long",
        ).withColumn("_item", F.monotonically_increasing_id()),
        "pieces",
    )
    placed = pack_items(pieces.select("_item", F.col("length").alias("_size")), capacity)
    return pieces.join(placed, "_item").drop("_item")
