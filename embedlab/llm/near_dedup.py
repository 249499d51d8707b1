"""Near-duplicates by ProbMinHash: weighted word shingles, banding, and exact verification.

Each shingle sends out points of a Poisson process with its weight as rate; the points visit the
registers in an order of the shingle's own, and a register keeps the shingle of its first point. A
shingle stops as soon as its next point comes later than all registers of its document. Two
documents agree in a register with probability equal to their probability Jaccard similarity.

Bands of registers give buckets. In a bucket every member is checked against the first and against
the one before it; what is linked is merged. Then members of a bucket that are still apart are
compared by their signatures, and the pairs that could be similar are verified where they are, so no
candidate pair is dropped while pairs are never listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embedlab.llm.components import connected_components
from embedlab.llm.repeats import BATCH_BYTES
from embedlab.llm.rolling import Powers, WordHashes, mix, prefix_sums, runs, signed, window_hashes
from embedlab.llm.rows import free_name, kept, keyed, prepare, record_batch, row_key, slices

SHINGLE_WORDS = 5
THRESHOLD = 0.8
REGISTERS = 127  # a prime, so that steps of any size visit every register
BAND_ROWS = 5  # at most; ``band_shape`` takes fewer for lower thresholds
LOST = 1e-4  # chance to miss a pair at the threshold
ESTIMATE_MARGIN = 0.2  # over five standard deviations of the estimate at the threshold
BUCKET_BLOCK = 512
BLOCK_TEXT = 4 << 20
BOUND_SLACK = 1e-9  # rounding of the bound, so that no pair at the threshold is lost by it
RUN_ROWS = 4096  # members of a bucket that are sorted together to find the one before


def band_shape(threshold: float) -> tuple[int, int]:
    """(bands, rows) with the most rows for which a pair at ``threshold`` is missed, by the bands and by
    the estimate together, with probability below ``LOST``; an error where none are."""

    agree = threshold + (1 - threshold) / 256  # signatures keep 8 bits of a register
    dropped = sum(
        comb(REGISTERS, k) * agree**k * (1 - agree) ** (REGISTERS - k)
        for k in range(REGISTERS + 1)
        if k / REGISTERS < threshold - ESTIMATE_MARGIN
    )
    for rows in range(BAND_ROWS, 0, -1):
        bands = REGISTERS // rows
        if (1 - threshold**rows) ** bands + dropped < LOST:
            return bands, rows
    raise ValueError(f"{REGISTERS} registers cannot find all pairs of similarity {threshold}")


def shingles(words: np.ndarray, powers: Powers, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a shorter text is one shingle of all its words."""

    if len(words) == 0:
        return words
    return mix(window_hashes(prefix_sums(words, powers), min(size, len(words)), powers))


def bag(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and how often each occurs."""

    values, counts = np.unique(hashes, return_counts=True)
    return values, counts.astype(float)


def signatures(owner: np.ndarray, items: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """ProbMinHash registers of ``n`` documents; ``owner`` is the document of each shingle."""

    first = np.full(n * REGISTERS, np.inf)
    winner = np.zeros(n * REGISTERS, np.uint64)
    step = mix(items ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(REGISTERS - 1) + np.uint64(1)
    place = mix(items ^ np.uint64(0x14057B7EF767814F)) % np.uint64(REGISTERS)
    step, place = step.astype(np.int64), place.astype(np.int64)
    time = np.zeros(len(items))
    for i in range(REGISTERS):
        draw = mix(items + np.uint64((i + 1) * 0xD1342543DE82EF95 % 2**64))
        uniform = ((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
        # of the registers not visited yet, the next comes at rate weight (R - i) / R
        time = time - np.log(uniform) * (REGISTERS / (REGISTERS - i)) / weights
        register = owner * REGISTERS + place
        np.minimum.at(first, register, time)
        won = time == first[register]
        winner[register[won]] = items[won]
        last = first.reshape(n, REGISTERS).max(axis=1)
        alive = time < last[owner]
        if not alive.any():
            break
        owner, items, weights, time, step = (x[alive] for x in (owner, items, weights, time, step))
        place = (place[alive] + step) % REGISTERS
    return winner.reshape(n, REGISTERS)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common items i of 1 / sum over j of max(x_j / x_i, y_j / y_i); 1 - it is a metric.

    Ordered by x_j / y_j, the maximum takes x from i's own place on and y before it.
    """

    items = np.union1d(a[0], b[0])
    x, y = np.zeros(len(items)), np.zeros(len(items))
    x[np.searchsorted(items, a[0])] = a[1]
    y[np.searchsorted(items, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1.0), np.inf)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    below = np.concatenate(([0.0], np.cumsum(y)))
    above = np.concatenate((np.cumsum(x[::-1])[::-1], [0.0]))
    both = np.flatnonzero((x > 0) & (y > 0))
    at = np.searchsorted(ratio, ratio[both], side="left")
    return float((1.0 / (above[at] / x[both] + below[at] / y[both])).sum())


class Bags:
    """The bags of one place, stored one after the other over a common numbering of the shingles."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.bags = bags
        self.sizes = np.array([len(values) for values, _ in bags], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        vocabulary, self.items = np.unique(np.concatenate([v for v, _ in bags]), return_inverse=True)
        self.weights = np.concatenate([w for _, w in bags])
        self.totals = np.add.reduceat(self.weights, self.starts[:-1])
        self.row = np.zeros(len(vocabulary))

    def bounds(self, i: int, others: np.ndarray) -> np.ndarray:
        """What the probability Jaccard of bag ``i`` with each of ``others`` can be at most.

        In the sum over j of max(x_j / x_i, y_j / y_i) the items of one side only are exact, and those of
        both sides count at least max(X / x_i, Y / y_i) with the sums X, Y over them. The bound is the
        value itself where the two agree on their common items up to a factor, as without repeats.
        """

        own = slice(self.starts[i], self.starts[i + 1])
        self.row[self.items[own]] = self.weights[own]
        sizes = self.sizes[others]
        owner = np.repeat(np.arange(len(others)), sizes)
        first = np.cumsum(sizes) - sizes
        entries = np.arange(len(owner)) + np.repeat(self.starts[others] - first, sizes)
        x = self.row[self.items[entries]]
        self.row[self.items[own]] = 0.0
        both = np.flatnonzero(x)
        x, y, owner = x[both], self.weights[entries[both]], owner[both]
        common_x = np.bincount(owner, x, len(others))
        common_y = np.bincount(owner, y, len(others))
        only_x, only_y = self.totals[i] - common_x, self.totals[others] - common_y
        whole = np.maximum(common_x[owner] / x, common_y[owner] / y) + only_x[owner] / x + only_y[owner] / y
        return np.bincount(owner, 1.0 / whole, len(others))

    def similar(self, i: int, j: int) -> float:
        return probability_jaccard(self.bags[i], self.bags[j])


def _words(hashes: WordHashes, text: bytes) -> np.ndarray:
    return hashes.of(text.lower().split())


def _signer(size: int, band_count: int, band_rows: int) -> Callable:
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("_key", pa.binary()),
            ("_node", pa.binary()),
            ("_signature", pa.binary()),
            ("_bands", pa.list_(pa.int64())),
            ("_bytes", pa.int64()),
        ]
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, hashes = Powers(), WordHashes()
        seeds = mix(np.arange(1, band_count * band_rows + 1, dtype=np.uint64))
        for batch in batches:
            for part, texts in slices(batch, "_text", BATCH_BYTES):
                bags = [bag(shingles(_words(hashes, t), powers, size)) for t in texts]
                counts = np.array([len(v) for v, _ in bags])
                filled = np.flatnonzero(counts)
                nodes, prints, bands = [], [], [None] * len(bags)
                table = np.empty((0, REGISTERS), np.uint64)
                if len(filled):
                    table = signatures(
                        np.repeat(np.arange(len(filled)), counts[filled]),
                        np.concatenate([bags[i][0] for i in filled]),
                        np.concatenate([bags[i][1] for i in filled]),
                        len(filled),
                    )
                mixed = mix(table[:, : band_count * band_rows] ^ seeds).reshape(-1, band_count, band_rows)
                bucket = signed(mix(mixed.sum(axis=2, dtype=np.uint64)))
                small = (mix(table) >> np.uint64(56)).astype(np.uint8)
                at = {int(i): k for k, i in enumerate(filled)}
                keys = part.column("_key").to_pylist()
                for i, (values, weight) in enumerate(bags):
                    if i not in at:
                        nodes.append(keys[i])
                        prints.append(b"")
                        continue
                    weight = weight.astype(np.uint64)
                    digest = [
                        (mix(values + np.uint64(salt)) * weight).sum(dtype=np.uint64) for salt in (1, 2)
                    ]
                    nodes.append(np.array(digest, np.uint64).tobytes())
                    prints.append(small[at[i]].tobytes())
                    bands[i] = bucket[at[i]]
                yield record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "_key": part.column("_key"),
                        "_node": nodes,
                        "_signature": prints,
                        "_bands": bands,
                        "_bytes": [len(t) for t in texts],
                    },
                    schema,
                )

    return sign


def _verifier(size: int, threshold: float) -> Callable:
    schema = pa.schema([("_a", pa.binary()), ("_b", pa.binary()), ("_similar", pa.bool_())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, hashes = Powers(), WordHashes()
        last: tuple = (None, None)
        for batch in batches:
            similar = []
            for a, text_a, text_b in zip(*(batch.column(c).to_pylist() for c in ("_a", "_text_a", "_text_b"))):
                if last[0] != a:
                    last = a, bag(shingles(_words(hashes, text_a), powers, size))
                other = bag(shingles(_words(hashes, text_b), powers, size))
                similar.append(probability_jaccard(last[1], other) >= threshold)
            yield record_batch(
                {"_a": batch.column("_a"), "_b": batch.column("_b"), "_similar": similar}, schema
            )

    return verify


_PLACE = ("_band", "_bucket", "_low", "_high")
_MEMBER = [
    ("_band", pa.int32()),
    ("_bucket", pa.int64()),
    ("_low", pa.int64()),
    ("_high", pa.int64()),
    ("_block", pa.int64()),
    ("_node", pa.binary()),
    ("_root", pa.binary()),
    ("_signature", pa.binary()),
    ("_bands", pa.list_(pa.int64())),
]
MEMBER_SCHEMA = (
    "_band int, _bucket long, _low long, _high long, _block long, _node binary, _root binary, "
    "_signature binary, _bands array<long>"
)


def _by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one bucket and pair of blocks at a time; input is ordered by them."""

    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = [batch.column(c).to_numpy() for c in _PLACE]
        for begin, end in zip(*runs(*keys)):
            place = tuple(k[begin] for k in keys)
            if waiting and place != last:
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting = []
            waiting.append(batch.slice(begin, end - begin))
            last = place
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _close_pairs(rows: pa.Table, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, other rows, agreement) of the pairs of a block pair that lie in different classes, agree in
    nearly as many registers as the threshold asks, and meet here first of all bands they share."""

    prints = np.frombuffer(b"".join(rows.column("_signature").to_pylist()), np.uint8).reshape(-1, REGISTERS)
    bands = pc.list_flatten(rows.column("_bands")).to_numpy().reshape(rows.num_rows, -1)
    band, low, high = (rows.column(c)[0].as_py() for c in ("_band", "_low", "_high"))
    roots = np.unique(np.array(rows.column("_root").to_pylist(), object), return_inverse=True)[1]
    blocks = rows.column("_block").to_numpy()
    first, second = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
    for i in first:
        others = second[second > i] if low == high else second
        others = others[roots[others] != roots[i]]
        agree = (prints[others] == prints[i]).mean(axis=1)
        near = agree >= threshold - ESTIMATE_MARGIN
        others, agree = others[near], agree[near]
        if len(others):
            new = ~(bands[others, :band] == bands[i, :band]).any(axis=1)
            if new.any():
                yield int(i), others[new], agree[new]


def _apart(threshold: float) -> Callable:
    """The members of a bucket and block pair that have a close partner in another class."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_place(batches):
            marked = np.zeros(rows.num_rows, bool)
            for i, others, _ in _close_pairs(rows, threshold):
                marked[i] = True
                marked[others] = True
            if marked.any():
                yield from rows.filter(pa.array(marked)).combine_chunks().to_batches()

    return find


def _linker(size: int, threshold: float) -> Callable:
    """Verify close pairs on the texts, skipping pairs whose classes have met by then: what comes out of
    a place are at most as many links as it has members.

    A member meets all its close partners at once: their bounds are taken together, and only partners
    that the bound leaves are verified, closest first.
    """

    schema = pa.schema([("_a", pa.binary()), ("_b", pa.binary())])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, hashes = Powers(), WordHashes()
        for rows in _by_place(batches):
            bags = Bags([bag(shingles(_words(hashes, t), powers, size)) for t in rows.column("_text").to_pylist()])
            nodes = rows.column("_node").to_pylist()
            # numbers of the classes as they merge; both arrays follow the rows and stay bounded by the place
            classes = np.unique(np.array(rows.column("_root").to_pylist(), object), return_inverse=True)[1]
            out: dict[str, list] = {"_a": [], "_b": []}
            for i, others, agree in _close_pairs(rows, threshold):
                others = others[np.argsort(-agree, kind="stable")]
                others = others[classes[others] != classes[i]]
                if len(others):
                    others = others[bags.bounds(i, others) >= threshold - BOUND_SLACK]
                for j in others.tolist():
                    if classes[i] != classes[j] and bags.similar(i, j) >= threshold:
                        classes[classes == classes[j]] = classes[i]
                        for name, node in zip(("_a", "_b"), sorted((nodes[i], nodes[j]))):
                            out[name].append(node)
            if out["_a"]:
                yield record_batch(out, schema)

    return link


class _Graph:
    """Candidate pairs verified so far and the components they give."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, size: int, threshold: float) -> None:
        self.texts, self.nodes, self.size, self.threshold = texts, nodes, size, threshold
        self.roots: DataFrame | None = None

    def found_texts(self, ends: DataFrame) -> DataFrame:
        """``_node``, ``_text`` of the nodes in ``ends``, kept. Rows of documents equal in id and text
        repeat a node; what they repeat does no harm."""

        wanted = self.nodes.select("_node", "_key").join(ends.distinct(), "_node", "left_semi")
        return kept(self.texts.select("_key", "_text").join(wanted, "_key").select("_node", "_text"), "texts")

    def add(self, links: DataFrame) -> None:
        """Merge the classes that ``links`` connect: only classes, not the nodes inside them, are linked anew."""

        if self.roots is None:
            self.roots = connected_components(kept(links, "similar"))
            return
        ends = _rooted(_rooted(links, self.roots, "_a", "_root_a"), self.roots, "_b", "_root_b")
        between = ends.where("_root_a <> _root_b").select(F.col("_root_a").alias("_a"), F.col("_root_b").alias("_b"))
        merged = connected_components(kept(between.distinct(), "similar"))
        moved = _rooted(self.roots.withColumnRenamed("_root", "_before"), merged, "_before", "_root")
        self.roots = kept(moved.select("_node", "_root").unionByName(merged), "roots")

    def verify(self, pairs: DataFrame) -> None:
        """Compare the texts of ``pairs`` (``_a``, ``_b``) and merge what is similar."""

        found = self.found_texts(
            pairs.select(F.col("_a").alias("_node")).unionByName(pairs.select(F.col("_b").alias("_node")))
        )
        wide = pairs.join(
            found.select(F.col("_node").alias("_b"), F.col("_text").alias("_text_b")), "_b"
        ).join(found.select(F.col("_node").alias("_a"), F.col("_text").alias("_text_a")), "_a")
        self.add(
            wide.select("_a", "_b", "_text_a", "_text_b")
            .mapInArrow(_verifier(self.size, self.threshold), "_a binary, _b binary, _similar boolean")
            .where("_similar")
            .select("_a", "_b")
        )


def _rooted(table: DataFrame, roots: DataFrame, node: str, root: str) -> DataFrame:
    names = roots.select(F.col("_node").alias(node), F.col("_root").alias(root))
    return table.join(names, node, "left").withColumn(root, F.coalesce(root, node))


def near_duplicate_nodes(docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """``doc_id, _key, _root``: the class of every row, named by one of its nodes."""

    prepare(docs.sparkSession)
    texts = keyed(docs)
    signed_rows = kept(
        texts.select("doc_id", "_key", "_text").mapInArrow(
            _signer(size, *band_shape(threshold)),
            "doc_id long, _key binary, _node binary, _signature binary, _bands array<long>, _bytes long",
        ),
        "signatures",
    )
    # documents with the same shingles are one node, shown by one of their keys
    nodes = kept(
        signed_rows.where(F.col("_bands").isNotNull())
        .groupBy("_node")
        .agg(
            F.min("_key").alias("_key"),
            F.first("_signature").alias("_signature"),
            F.first("_bands").alias("_bands"),
            F.first("_bytes").alias("_bytes"),
        ),
        "nodes",
    )
    members = nodes.select("_node", F.posexplode("_bands").alias("_band", "_bucket"))
    # the member before is taken within runs of bounded size; it only has to be some other member
    run = F.pmod(F.xxhash64("_node"), F.ceil(F.col("_size") / RUN_ROWS))
    in_bucket = Window.partitionBy("_band", "_bucket", "_run")
    sizes = members.groupBy("_band", "_bucket").agg(
        F.count("*").alias("_size"), F.min("_node").alias("_first")
    ).where("_size > 1")
    shared = kept(members.join(sizes, ["_band", "_bucket"]), "shared")
    before = F.lag("_node").over(in_bucket.orderBy("_node"))
    chosen = shared.select("_node", F.col("_first").alias("_other")).unionByName(
        shared.withColumn("_run", run).select("_node", before.alias("_other"))
    )
    pairs = (
        chosen.where("_other < _node")
        .groupBy(F.col("_other").alias("_a"), F.col("_node").alias("_b"))
        .agg(F.count("*").alias("_votes"))
    )
    pairs = kept(_estimated(pairs, nodes, threshold), "pairs")
    graph = _Graph(texts, nodes, size, threshold)
    best = Window.partitionBy("_b").orderBy(F.desc("_agree"), "_a")
    graph.verify(pairs.withColumn("_nth", F.row_number().over(best)).where("_nth = 1").select("_a", "_b"))
    rest = _rooted(_rooted(pairs, graph.roots, "_a", "_root_a"), graph.roots, "_b", "_root_b")
    graph.verify(kept(rest.where("_root_a <> _root_b").select("_a", "_b"), "pairs"))

    _link_what_is_apart(graph, shared, nodes, size, threshold)
    return _rooted(signed_rows.select("doc_id", "_key", "_node"), graph.roots, "_node", "_root")


def _link_what_is_apart(graph: _Graph, shared: DataFrame, nodes: DataFrame, size: int, threshold: float) -> None:
    """Compare the members of a bucket that are still in different classes, block against block.

    Members of the largest class of a bucket meet the others only, not each other, so a hot bucket with
    few outliers costs its size times their number. First by signatures, which leaves the members that may have a partner; then on their texts. Blocks
    are bounded in rows and in text, so a bucket of any size is many tasks of bounded memory.
    """

    members = shared.select("_band", "_bucket", "_node")
    placed = _rooted(members, graph.roots, "_node", "_root").join(nodes.select("_node", "_bytes"), "_node")
    classes = placed.groupBy("_band", "_bucket", "_root").agg(F.count("*").alias("_n"), F.sum("_bytes").alias("_v"))
    most = F.max(F.struct("_n", "_v", "_root"))
    blocks = lambda n, v: F.ceil(F.greatest(n / BUCKET_BLOCK, v / BLOCK_TEXT))
    mixed = (
        classes.groupBy("_band", "_bucket")
        .agg(most.alias("_most"), F.sum("_n").alias("_n"), F.sum("_v").alias("_v"), F.count("*").alias("_classes"))
        .where("_classes > 1")
        .select(
            "_band",
            "_bucket",
            F.col("_most._root").alias("_largest"),
            blocks(F.col("_most._n"), F.col("_most._v")).alias("_own"),
            blocks(F.col("_n") - F.col("_most._n"), F.col("_v") - F.col("_most._v")).alias("_others"),
        )
    )
    # blocks of all other classes come first, then those of the largest class, which never meet each other
    largest = F.col("_root") == F.col("_largest")
    spot = F.xxhash64("_node")
    blocked = (
        placed.join(mixed, ["_band", "_bucket"])
        .withColumn(
            "_block",
            F.when(largest, F.col("_others") + F.pmod(spot, "_own")).otherwise(F.pmod(spot, "_others")),
        )
        .withColumn("_meets", F.when(largest, F.col("_others")).otherwise(F.col("_others") + F.col("_own")))
        .withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_meets") - 1)))
        .withColumn("_low", F.least("_block", "_with"))
        .withColumn("_high", F.greatest("_block", "_with"))
        .join(nodes.select("_node", "_signature", "_bands"), "_node")
        .select(*[name for name, _ in _MEMBER])
    )
    ordered = lambda df: df.repartition(*_PLACE).sortWithinPartitions(*_PLACE)
    close = kept(ordered(blocked).mapInArrow(_apart(threshold), MEMBER_SCHEMA), "close")
    found = graph.found_texts(close.select("_node"))
    graph.add(
        ordered(close.join(found, "_node")).mapInArrow(_linker(size, threshold), "_a binary, _b binary")
    )


def _estimated(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose signatures agree nearly as often as the threshold, with that share."""

    schema = pa.schema([("_a", pa.binary()), ("_b", pa.binary()), ("_agree", pa.float64())])

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS)
                for c in ("_x", "_y")
            )
            agree = (x == y).mean(axis=1)
            close = pa.array(agree >= threshold - ESTIMATE_MARGIN)
            yield record_batch(
                {
                    "_a": pc.filter(batch.column("_a"), close),
                    "_b": pc.filter(batch.column("_b"), close),
                    "_agree": pc.filter(pa.array(agree), close),
                },
                schema,
            )

    prints = nodes.select("_node", "_signature")
    wide = pairs.join(prints.select(F.col("_node").alias("_b"), F.col("_signature").alias("_y")), "_b").join(
        prints.select(F.col("_node").alias("_a"), F.col("_signature").alias("_x")), "_a"
    )
    return wide.select("_a", "_b", "_x", "_y").mapInArrow(estimate, "_a binary, _b binary, _agree double")


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its class), class_size.

    Words are separated by ASCII white space, with A-Z lower-cased; shingles of ``size`` words are
    weighted by their number, and classes are what links of similarity ``threshold`` or more connect.
    A text of fewer words is one shingle; a null text, or one without words, is alone (equal rows
    together). A class without any id has a null class_id. Other columns are ignored.

    A pair at the threshold shares a bucket, and its signatures agree often enough to be verified, with
    probability above 0.9999 together; bands follow from ``threshold``, and one too low for that (under
    about 0.07) is an error. Every such pair that is not yet in one class is
    then decided on the whole texts.
    """

    rows = kept(near_duplicate_nodes(docs, size, threshold), "classes")
    classes = rows.groupBy("_root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(classes, "_root").select("doc_id", "class_id", "class_size")


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each class (null ids last), with their columns."""

    rows = kept(near_duplicate_nodes(docs, size, threshold), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_key").alias("k"))
    first = rows.groupBy("_root").agg(F.min(order).alias("_first"))
    key, nth = free_name(docs, "_row_key"), free_name(docs, "_nth")
    dropped = (
        rows.join(first, "_root").where(F.col("_key") != F.col("_first.k")).select(F.col("_key").alias(key)).distinct()
    )
    return (
        docs.withColumn(key, row_key())
        .join(dropped, key, "left_anti")
        .withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key)))
        .where(F.col(nth) == 1)
        .select(*docs.columns)
    )
