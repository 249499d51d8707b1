"""Suffix-array deduplication on bytes: longest previous factors from neighbours in suffix order.

The corpus is cut into groups that can share a long string (see ``repeats``); each group's suffixes
are sorted, and the previous and next smaller text positions in suffix order give every suffix its
longest match with an earlier one. The mirror image gives the longest match with a later one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
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
from embedlab.llm.rolling import Powers, covered, mix, prefix_sums, runs, signed, window_hashes
from embedlab.llm.rows import kept, keyed, prepare, record_batch, slices

LENGTH_BYTES = 400
ANCHOR_BYTES = 64
GROUP_VARIANTS = 4096
BLOCK_BYTES = 1 << 20


def suffix_ranks(data: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of all suffixes by their first 1, 2, 4, ... bytes, up to at least ``depth`` bytes.

    Equal ranks mean equal prefixes of that size. A suffix that ends early sorts first.
    """

    ranks = data.astype(np.int32) + 1
    levels, size = [(1, ranks)], 1
    while size < depth:
        second = np.zeros(len(ranks), np.int64)
        second[: max(len(ranks) - size, 0)] = ranks[size:]
        joint = ranks.astype(np.int64) * (int(ranks.max(initial=0)) + 2) + second
        if size > 1:
            order = np.argsort(joint)
            step = np.ones(len(joint), np.int32)
            ordered = joint[order]
            step[1:] = ordered[1:] != ordered[:-1]
            ranks = np.empty(len(joint), np.int32)
            ranks[order] = np.cumsum(step)
        else:
            ranks = joint.astype(np.int32)
        size *= 2
        levels.append((size, ranks))
    return levels


def common_prefixes(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes a[i] and b[i], up to twice the deepest level."""

    total = len(levels[0][1])
    length = np.zeros(len(a), np.int64)
    for size, ranks in reversed(levels):
        x, y = a + length, b + length
        inside = np.maximum(x, y) + size <= total
        same = np.zeros(len(a), bool)
        same[inside] = ranks[x[inside]] == ranks[y[inside]]
        length += size * same
    return length


def _nearest_smaller(values: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest smaller value before it (-1 if none) and the least ``lcp``
    between; ``lcp[i]`` belongs to places i-1 and i. Pointers jump over finished stretches."""

    target = np.arange(len(values)) - 1
    least = lcp.copy()
    open_places = np.flatnonzero(target >= 0)
    while len(open_places):
        at = target[open_places]
        open_places = open_places[values[at] > values[open_places]]
        at = target[open_places]
        least[open_places] = np.minimum(least[open_places], least[at])
        target[open_places] = target[at]
        open_places = open_places[target[open_places] >= 0]
    least[target < 0] = 0
    return target, least


def longest_factors(
    data: np.ndarray, places: np.ndarray, depth: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest previous factor, longest next factor and a place of the earlier match.

    For every suffix start in ``places`` (ascending): the longest common prefix with a suffix that
    starts at an earlier, or a later, one of them. Exact below ``depth``, at least ``depth`` above.
    """

    none = np.full(len(places), -1)
    if len(places) == 0:
        return none, none, none
    levels = suffix_ranks(data, depth)
    order = places[np.argsort(levels[-1][1][places], kind="stable")]
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = common_prefixes(levels, order[:-1], order[1:])
    back = np.concatenate(([0], lcp[:0:-1]))
    found = {}
    for name, sign in (("previous", 1), ("next", -1)):
        before, up = _nearest_smaller(sign * order, lcp)
        after, down = _nearest_smaller(sign * order[::-1], back)
        after, down = after[::-1], down[::-1]
        after = np.where(after >= 0, len(order) - 1 - after, -1)
        best = np.where(up >= down, before, after)
        found[name] = np.maximum(up, down), np.where(best >= 0, order[best], -1)
    by_place = np.argsort(order, kind="stable")
    previous, source = found["previous"]
    return previous[by_place], found["next"][0][by_place], source[by_place]


def _byte_items() -> Callable[[bytes], np.ndarray]:
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    return lambda text: table[np.frombuffer(text, np.uint8)]


def _snippet_emitter(length: int) -> Callable:
    """The texts of the first copies of run contents that share an anchor with other contents."""

    schema = pa.schema(
        [
            ("_anchor", pa.int64()),
            ("_key", pa.binary()),
            ("_rank", pa.int64()),
            ("_start", pa.int32()),
            ("_bytes", pa.binary()),
        ]
    )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_text", BATCH_BYTES):
                wanted = part.column("_runs").to_pylist()
                ranks = part.column("_rank").to_pylist()
                out: dict[str, list] = {name: [] for name in schema.names}
                for key, rank, text, found in zip(part.column("_key").to_pylist(), ranks, texts, wanted):
                    for run in found:
                        out["_anchor"].append(run["_anchor"])
                        out["_key"].append(key)
                        out["_rank"].append(rank)
                        out["_start"].append(run["_start"])
                        out["_bytes"].append(text[run["_start"] : run["_start"] + run["_width"] + length - 1])
                yield record_batch(out, schema)

    return emit


def _window_emitter(length: int) -> Callable:
    """Single windows of the runs of hot anchors, under the hash of all their bytes."""

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
        powers, convert = Powers(), _byte_items()
        for batch in batches:
            rows, places, hashes, guards = [], [], [], []
            starts = batch.column("_start").to_pylist()
            for row, (text, start) in enumerate(zip(batch.column("_bytes").to_pylist(), starts)):
                items = convert(text)
                windows = window_hashes(prefix_sums(items, powers), length, powers)
                rows.append(np.full(len(windows), row))
                places.append(start + np.arange(len(windows)))
                hashes.append(mix(windows))
                guards.append(window_hashes(prefix_sums(mix(items), powers), length, powers))
            if rows:
                take = pa.array(np.concatenate(rows))
                yield record_batch(
                    {
                        "_hash": signed(np.concatenate(hashes)),
                        "_guard": signed(np.concatenate(guards)),
                        "_key": batch.column("_key").take(take),
                        "_rank": batch.column("_rank").take(take),
                        "_start": np.concatenate(places),
                    },
                    schema,
                )

    return emit


def _group_matcher(length: int, keep_first: bool) -> Callable:
    """Suffix-sort whole anchor groups, several together: rows come ordered by anchor and place.

    Groups never share a string of ``length`` bytes, so sorting them in one block changes nothing.
    """

    schema = pa.schema([("_key", pa.binary()), ("_starts", pa.list_(pa.int32())), ("_width", pa.int32())])

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        group = pa.Table.from_batches(rows).combine_chunks()
        texts = group.column("_bytes").to_pylist()
        sizes = np.array([len(t) for t in texts])
        base = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(texts)), sizes)
        inside = np.arange(sizes.sum()) - base[owner]
        places = np.flatnonzero(inside <= sizes[owner] - length)
        data = np.frombuffer(b"".join(texts), np.uint8)
        previous, following, _ = longest_factors(data, places, length)
        gone = previous >= length if keep_first else np.maximum(previous, following) >= length
        first, last = runs(gone, owner[places])
        kept_runs = gone[first]
        first, last = first[kept_runs], last[kept_runs]
        row = owner[places[first]]
        start = group.column("_start").to_numpy()[row] + inside[places[first]]
        ones = pa.array(np.arange(len(first) + 1), pa.int32())
        return record_batch(
            {
                "_key": group.column("_key").combine_chunks().take(pa.array(row)),
                "_starts": pa.ListArray.from_arrays(ones, pa.array(start, pa.int32())),
                "_width": last - first,
            },
            schema,
        )

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            anchors = batch.column("_anchor").to_numpy()
            sizes = np.asarray(pc.binary_length(batch.column("_bytes")), dtype=np.int64)
            for begin, end in zip(*runs(anchors)):
                new = not waiting or waiting[-1].column("_anchor")[-1].as_py() != anchors[begin]
                if new and size >= BLOCK_BYTES:
                    yield solve(waiting)
                    waiting, size = [], 0
                waiting.append(batch.slice(begin, end - begin))
                size += int(sizes[begin:end].sum())
        if waiting:
            yield solve(waiting)

    return match


def repeated_strings(texts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Ranges of window starts whose ``length`` bytes also start elsewhere (earlier only, with
    ``keep_first``). A group of suffixes that share an anchor is sorted in one task; an anchor with
    over ``GROUP_VARIANTS`` different surroundings is split by the hash of the whole window, below
    which all suffixes match for ``length`` bytes and only their order of occurrence matters. That
    bounds what a task sorts at once to about 2 MB of text and 200 MB of ranks."""

    inner = min(ANCHOR_BYTES, max(1, length // 2))
    found = kept(
        texts.select("_key", "_rank", "_text").mapInArrow(
            run_emitter(_byte_items, length, inner), RUN_SCHEMA
        ),
        "runs",
    )
    live = live_runs(found, across_documents=False)
    live = live.withColumn("_start", F.col("_starts")[0])
    place = F.struct("_rank", "_key", "_start")
    contents = live.groupBy("_anchor", "_content").agg(
        F.min(place).alias("_first"), F.sum(F.size("_starts")).alias("_copies")
    )
    variants = contents.groupBy("_anchor").agg(F.count("*").alias("_variants"))
    judged = kept(
        live.join(contents, ["_anchor", "_content"])
        .join(variants, "_anchor")
        .withColumn("_is_first", place == F.col("_first"))
        .drop("_first", "_content"),
        "judged",
    )
    later = F.when(F.col("_is_first") & F.lit(keep_first), F.slice("_starts", 2, F.size("_starts")))
    whole = judged.where("_copies > 1").select("_key", later.otherwise(F.col("_starts")).alias("_starts"), "_width")
    opened = judged.where("_is_first and _variants > 1")
    wanted = opened.groupBy("_key").agg(
        F.collect_list(F.struct("_anchor", "_start", "_width")).alias("_runs")
    )
    snippets = kept(
        texts.select("_key", "_rank", "_text")
        .join(wanted, "_key")
        .mapInArrow(
            _snippet_emitter(length),
            "_anchor long, _key binary, _rank long, _start int, _bytes binary",
        )
        .dropDuplicates(["_anchor", "_key", "_start"]),
        "snippets",
    )
    hot = variants.where(F.col("_variants") > GROUP_VARIANTS).select("_anchor")
    sorted_groups = (
        snippets.join(hot, "_anchor", "left_anti")
        .repartition("_anchor")
        .sortWithinPartitions("_anchor", "_rank", "_key", "_start")
        .mapInArrow(_group_matcher(length, keep_first), "_key binary, _starts array<int>, _width int")
    )
    windows = snippets.join(hot, "_anchor", "left_semi").mapInArrow(
        _window_emitter(length), "_hash long, _guard long, _key binary, _rank long, _start int"
    )
    owners = windows.groupBy("_hash", "_guard").agg(
        F.min(place).alias("_first"), F.count("*").alias("_copies")
    )
    split = windows.join(owners.where("_copies > 1"), ["_hash", "_guard"])
    if keep_first:
        split = split.where(place != F.col("_first"))
    return whole.unionByName(sorted_groups).unionByName(
        split.select("_key", F.array("_start").alias("_starts"), F.lit(1).alias("_width"))
    )


def _remover(length: int) -> Callable:
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_bytes", pa.int64()),
            ("n_removed", pa.int64()),
            ("n_spans", pa.int64()),
            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
            ("kept_bytes", pa.binary()),
            ("kept_sha256", pa.string()),
        ]
    )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_text", BATCH_BYTES):
                out: dict[str, list] = {name: [] for name in schema.names}
                ids = part.column("doc_id").to_pylist()
                for doc, text, (first, last) in zip(ids, texts, span_arrays(part.column("_spans"))):
                    gone = covered(first, last + length - 1, len(text))
                    begin, end = runs(gone)
                    cut = [(int(b), int(e)) for b, e in zip(begin, end) if gone[b]]
                    left = b"".join(text[b:e] for b, e in zip(begin, end) if not gone[b])
                    out["doc_id"].append(doc)
                    out["n_bytes"].append(len(text))
                    out["n_removed"].append(int(gone.sum()))
                    out["n_spans"].append(len(cut))
                    out["spans"].append([{"start": b, "stop": e} for b, e in cut])
                    out["kept_bytes"].append(left)
                    out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                yield record_batch(out, schema)

    return remove


def remove_repeated_bytes(
    docs: DataFrame, length: int = LENGTH_BYTES, keep_first: bool = True
) -> DataFrame:
    """Cut every byte covered by a ``length``-byte string that also starts elsewhere.

    With ``keep_first`` the first copy (smallest id, then position) stays, which is where the
    longest previous factor is shorter than ``length``; without it all copies go. Strings are judged
    on the input and may overlap; matches never cross documents.

    Returns per row: doc_id, n_bytes, n_removed, n_spans, spans, kept_bytes and its SHA-256. A null
    text is empty. A null id ranks last. Repeated rows are copies of each other; with ``keep_first``
    rows equal in id and text cannot be told apart and count as one place. Other columns are ignored.
    """

    prepare(docs.sparkSession)
    texts = keyed(docs)
    spans = spans_by_document(repeated_strings(texts, length, keep_first))
    return (
        texts.select("_key", "doc_id", "_text")
        .join(spans, "_key", "left")
        .mapInArrow(
            _remover(length),
            "doc_id long, n_bytes long, n_removed long, n_spans long, "
            "spans array<struct<start:int,stop:int>>, kept_bytes binary, kept_sha256 string",
        )
    )
