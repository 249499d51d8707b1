"""Counting Bloom filters of bounded size: built sparsely by tasks, merged through one small shuffle.

A filter has ``cells`` counters that stop at two, kept as two bits each, so it never takes more than
``MAX_CELLS / 4`` bytes on the driver or in a task. It follows the number of rows up to that bound;
beyond it more rows look repeated than are, which costs work and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACES = 3
CELLS_PER_ROW = 16
MAX_CELLS = 1 << 28
CHUNK_CELLS = 1 << 16
FLUSH_ROWS = 1 << 20
_PART = pa.schema([("_chunk", pa.int32()), ("_once", pa.binary()), ("_more", pa.binary())])


def cells_for(rows: int, bound: int = MAX_CELLS) -> int:
    """A power of two of about ``CELLS_PER_ROW`` counters a row, at most ``bound``."""

    return min(bound, max(CHUNK_CELLS, 1 << (max(rows, 1) * CELLS_PER_ROW - 1).bit_length()))


def places(first: np.ndarray, second: np.ndarray, cells: int) -> np.ndarray:
    """The ``PLACES`` cells of every row, from two 64-bit hashes."""

    first = np.asarray(first, np.int64).view(np.uint64)
    step = np.asarray(second, np.int64).view(np.uint64) | np.uint64(1)
    return np.stack([(first + np.uint64(i) * step) & np.uint64(cells - 1) for i in range(PLACES)]).astype(np.int64)


def _sparse(where: np.ndarray, width: int) -> Iterator[tuple[int, bytes, bytes]]:
    cell, count = np.unique(where, return_counts=True)
    chunk = cell // width
    edges = np.concatenate(([0], np.flatnonzero(np.diff(chunk)) + 1, [len(cell)]))
    offset = (cell % width).astype(np.uint16)
    for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if end > start:
            part, once = offset[start:end], count[start:end] == 1
            yield int(chunk[start]), part[once].tobytes(), part[~once].tobytes()


def _count(cells: int, width: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def flush():
            rows = list(_sparse(np.concatenate(waiting), width)) if waiting else []
            waiting.clear()
            for at in range(0, len(rows), 64):
                columns = zip(*rows[at : at + 64])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PART)], schema=_PART)

        for batch in batches:
            first, second = (c.to_numpy(zero_copy_only=False) for c in (batch.column("_h1"), batch.column("_h2")))
            waiting.append(places(first, second, cells).reshape(-1))
            size += batch.num_rows
            if size >= FLUSH_ROWS:
                yield from flush()
                size = 0
        yield from flush()

    return count


def _merge(width: int):
    schema = pa.schema([("_chunk", pa.int32()), ("_bits", pa.binary())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, counts = None, np.zeros(width, np.uint8)

        def packed():
            quads = counts.reshape(-1, 4)
            bits = quads[:, 0] | (quads[:, 1] << 2) | (quads[:, 2] << 4) | (quads[:, 3] << 6)
            columns = [pa.array([current], pa.int32()), pa.array([bits.tobytes()])]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if row["_chunk"] != current:
                    if current is not None:
                        yield packed()
                    current = row["_chunk"]
                    counts[:] = 0
                counts[np.frombuffer(row["_once"], np.uint16)] += 1
                counts[np.frombuffer(row["_more"], np.uint16)] += 2
                np.minimum(counts, 2, out=counts)
        if current is not None:
            yield packed()

    return merge


def counting_filter(hashes: DataFrame, cells: int) -> np.ndarray:
    """The merged filter over ``_h1, _h2`` as packed two-bit counters, ``cells / 4`` bytes."""

    width = min(CHUNK_CELLS, cells)
    parts = hashes.select("_h1", "_h2").mapInArrow(_count(cells, width), "_chunk int, _once binary, _more binary")
    merged = (
        parts.repartition("_chunk").sortWithinPartitions("_chunk").mapInArrow(_merge(width), "_chunk int, _bits binary")
    )
    packed = np.zeros(cells // 4, np.uint8)
    for row in merged.toLocalIterator():
        at = row["_chunk"] * width // 4
        packed[at : at + width // 4] = np.frombuffer(row["_bits"], np.uint8)
    return packed


def least_count(packed: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The smallest counter of every row: 1 means that no other row has its hashes."""

    where = places(first, second, len(packed) * 4)
    return ((packed[where >> 2] >> ((where & 3) << 1).astype(np.uint8)) & 3).min(axis=0)


def at_least(broadcast, wanted: int):
    """A boolean column function of (_h1, _h2): whether the broadcast filter counts ``wanted`` or more."""

    @F.pandas_udf("boolean")
    def seen(first, second):
        import pandas as pd

        found = least_count(broadcast.value, first.to_numpy(np.int64), second.to_numpy(np.int64))
        return pd.Series(found >= wanted)

    return seen
