"""Words, pieces and phrase windows of joined texts as arrays."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

LONGEST = 4
BLOCK_BYTES = 16 << 20
ROWS_OUT = 1 << 16
COUNT_SCHEMA = "lang string, phrase string, f long"
_COUNT_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
_BREAKS = b".,;:!?\n\x0b\x0c\r"
#: stands for a break between pieces; no byte of UTF-8 text
BREAK = b"\xff"
_FOLD = bytes.maketrans(
    ascii_uppercase.encode() + _BREAKS + b"\t", ascii_lowercase.encode() + BREAK * len(_BREAKS) + b" "
)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 1 << 20


def fold(text: bytes | None) -> bytes:
    """A-Z lower-cased, breaks between pieces as one byte, tabs as blanks."""

    return (text or b"").translate(_FOLD)


def _apart(data: bytes) -> bytes:
    return data.replace(BREAK, b" " + BREAK + b" ")


def word_hash(lang: str, word: bytes) -> int:
    """Also ``xxhash64(concat(lang, char(0), word))`` in Spark, as an unsigned number."""

    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + word, 42)


def extend_hash(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase that is longer by one word."""

    h = phrase * _STEP + word
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def phrase_hash(lang: str, phrase: str) -> np.uint64:
    hashes = np.array([word_hash(lang, w) for w in phrase.encode().split(b" ")], np.uint64)
    value = hashes[:1]
    for i in range(1, len(hashes)):
        value = extend_hash(value, hashes[i : i + 1])
    return value[0]


class Members:
    """Membership in a set of hashes: a bit table first, the sorted hashes for what it lets through."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(np.asarray(hashes, np.uint64))
        self.table = np.zeros(_SLOTS, bool)
        self.table[(self.hashes & np.uint64(_SLOTS - 1)).astype(np.int64)] = True

    def __call__(self, values: np.ndarray) -> np.ndarray:
        found = self.table[(values & np.uint64(_SLOTS - 1)).view(np.int64)]
        if len(self.hashes):
            maybe = np.flatnonzero(found)
            at = np.minimum(np.searchsorted(self.hashes, values[maybe]), len(self.hashes) - 1)
            found[maybe] = self.hashes[at] == values[maybe]
        return found


def blocks(data: bytes, limit: int = BLOCK_BYTES) -> Iterator[tuple[bytes, int]]:
    """Blocks of about ``limit`` bytes and how many of their first tokens the block before has counted.

    Cut between pieces; a longer piece is cut between words, and its last words are carried over.
    """

    at, counted = 0, 0

    def block(end: int) -> tuple[bytes, int]:
        return data[at:end], len(_apart(data[at : min(counted, end)]).split())

    while len(data) - at > limit:
        cut = data.rfind(BREAK, at, at + limit)
        if cut > at:
            yield block(cut)
            at = cut + 1
            continue
        # no break between pieces: end at a word, far enough on to leave words to carry over
        size, tokens = limit, []
        while at + size < len(data):
            cut = data.rfind(b" ", at, at + size)
            tokens = _apart(data[at:cut]).split() if cut > at else []
            if len(tokens) > 2 * LONGEST:
                break
            size *= 2
        if at + size >= len(data):
            break
        yield block(cut)
        counted = cut
        # step back over the words that windows of the next block begin with
        at = cut
        for token in tokens[: -LONGEST : -1]:
            at = data.rfind(token, 0, at)
    yield block(len(data))


class Block:
    """Local numbers of the words of one block of one language; breaks are tokens of their own."""

    def __init__(self, data: bytes, carried: int):
        data = _apart(data) + b" "
        raw = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(raw == 32).astype(np.int32) + 1
        offsets = np.concatenate(([0], ends)).astype(np.int32)
        # every token with the blank behind it, without a copy
        tokens = pa.BinaryArray.from_buffers(
            pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
        ).dictionary_encode()
        words = [w[:-1] for w in tokens.dictionary.to_pylist()]
        ids = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        empty = words.index(b"") if b"" in words else -1
        self.ids = ids[ids != empty] if empty >= 0 else ids
        self.words = pa.array(words, pa.binary())
        self.broken = self.ids == (words.index(BREAK) if BREAK in words else -1)
        self.carried = carried

    def hashes(self, lang: str) -> np.ndarray:
        prefix = lang.encode() + b"\0"
        digest = xxhash.xxh64_intdigest
        return np.array([digest(prefix + w, 42) for w in self.words.to_pylist()], np.uint64)

    def valid(self, m: int) -> np.ndarray:
        """Window starts of ``m`` words within a piece, not already counted by the block before."""

        n = len(self.ids) - m + 1
        if n <= 0:
            return np.zeros(0, bool)
        inside = ~self.broken[:n]
        for i in range(1, m):
            inside &= ~self.broken[i : i + n]
        inside[: max(0, min(n, self.carried - m + 1))] = False
        return inside

    def count(self, starts: np.ndarray, m: int) -> tuple[pa.Array, np.ndarray]:
        """Distinct phrases at these window starts and how often each occurs; exact, not by hash."""

        size = len(self.words)
        if m <= 2:
            key, count = np.unique(
                self.ids[starts] if m == 1 else self.ids[starts] * size + self.ids[starts + 1], return_counts=True
            )
            columns = [key] if m == 1 else [key // size, key % size]
        else:
            rank = self.ids[starts]
            for i in range(1, m):
                rank = np.unique(rank * size + self.ids[starts + i], return_inverse=True)[1]
            _, first, count = np.unique(rank, return_index=True, return_counts=True)
            columns = [self.ids[starts[first] + i] for i in range(m)]
        taken = [self.words.take(pa.array(c)) for c in columns]
        return (pc.binary_join_element_wise(*taken, b" ") if m > 1 else taken[0]), count


def by_language(batches: Iterable[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[str, Block]]:
    """Blocks of folded text per language from (lang, text) batches; at most ``limit`` bytes wait."""

    waiting: defaultdict[str, list[bytes]] = defaultdict(list)
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            data = fold(text)
            if size + len(data) > limit:
                yield from _release(waiting, limit)
                size = 0
            waiting[lang].append(data)
            size += len(data)
    yield from _release(waiting, limit)


def _release(waiting: dict[str, list[bytes]], limit: int) -> Iterator[tuple[str, Block]]:
    while waiting:
        lang, texts = waiting.popitem()
        for data, carried in blocks(BREAK.join(texts), limit):
            yield lang, Block(data, carried)


def _rows(lang: str, phrases: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(phrases), ROWS_OUT):
        part = phrases.slice(at, ROWS_OUT)
        yield pa.RecordBatch.from_arrays(
            [
                pa.repeat(pa.scalar(lang), len(part)),
                part.cast(pa.string()),
                pa.array(counts[at : at + ROWS_OUT].astype(np.int64)),
            ],
            schema=_COUNT_ARROW,
        )


def word_counter(limit: int) -> Callable:
    """Arrow function from (lang, text) to counts of words; the empty phrase counts all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block in by_language(batches, limit):
            starts = np.flatnonzero(block.valid(1))
            if len(starts):
                yield from _rows(lang, pa.array([b""]), np.array([len(starts)]))
                yield from _rows(lang, *block.count(starts, 1))

    return count


def pair_counter(frequent: Callable[[np.ndarray], np.ndarray], limit: int) -> Callable:
    """Arrow function to counts of word pairs; ``frequent`` tells from hashes which words can take part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block in by_language(batches, limit):
            if len(block.ids) > 1:
                known = frequent(block.hashes(lang))[block.ids]
                starts = np.flatnonzero(block.valid(2) & known[:-1] & known[1:])
                yield from _rows(lang, *block.count(starts, 2))

    return count


def growth_counter(sets, limit: int) -> Callable:
    """Arrow function to counts of the phrases that begin or end with a grown phrase and are longer by
    one word, and of the phrases asked for. ``sets`` broadcasts the hashes: grown pairs, grown triples,
    triples asked for, and the first two words of all these triples."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, triples, asked, leads = (Members(h) for h in sets.value)
        for lang, block in by_language(batches, limit):
            if len(block.ids) < 3:
                continue
            word = block.hashes(lang)[block.ids]
            two = extend_hash(word[:-1], word[1:])
            grown = pairs(two)
            take = grown[:-1] | grown[1:]
            lead = np.flatnonzero(leads(two)[:-1])
            three = extend_hash(two[lead], word[lead + 2])
            take[lead] |= asked(three)
            starts = np.flatnonzero(take & block.valid(3))
            yield from _rows(lang, *block.count(starts, 3))
            inside = np.zeros(len(take), bool)
            inside[lead] = triples(three)
            if len(block.ids) > 3 and inside.any():
                starts = np.flatnonzero((inside[:-1] | inside[1:]) & block.valid(4))
                yield from _rows(lang, *block.count(starts, 4))

    return count
