"""Byte-pair encoding as a streaming transducer with bounded lookahead, and incremental decoding.

A merge can be undone by what follows only through a chain of earlier-ranked merges, so the list of
merges bounds how far ahead one must look before a token is certain (``sufficient_lookahead``).
Characters are fed in; a token is given out once it ends that far before the end of the buffer, and
the buffer never grows past a constant size however long the word is.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlab.llm.rows import prepare, record_batch, slices

MAX_CACHED_WORDS = 500_000
BATCH_WORDS = 1 << 14
BATCH_BYTES = 4 << 20
OTHER = "\n"  # marks words that the library has split
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
NO_RULE = 1 << 62
# fixed values: the split pattern of the vocabulary file, for lower-case Latin-1 letters, digits and
# ASCII signs; other characters go through the library's own splitting
LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \na-z0-9ß-öø-ÿ]+")
LATIN = re.compile(r"[ \n!-~À-ÖØ-öø-ÿ]*+")
# fixed values: printable bytes stand for themselves, the others for characters from 256 on
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARACTERS = {b: b for b in PRINTABLE} | {
    b: 256 + n for n, b in enumerate(b for b in range(256) if b not in PRINTABLE)
}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Merges:
    """The vocabulary and ranked merges of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.rules: dict[tuple[int, int], int] = {}  # rank above the bits of the id made
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        for rank, (left, right) in enumerate(pairs):
            rule = (self.ids[left], self.ids[right])
            self.rules[rule] = rank << ID_BITS | self.ids[left + right]
        self.length = {
            number: len(token.removesuffix(self.suffix)) if self.suffix else len(token)
            for token, number in self.ids.items()
        }
        self.longest = max(self.length.values(), default=1)
        self.lookahead = self.sufficient_lookahead()

    def sufficient_lookahead(self) -> int:
        """Characters beyond a token's end that can still decide whether it appears.

        Merges are taken by rank. ``reach[left]`` is how far beyond ``left`` one must see to know that
        none of the merges so far takes it; ``doubt[token]`` how far beyond a token its making depends.
        """

        reach: dict[int, int] = {}
        doubt: dict[int, int] = {}
        most = 0
        for (left, right), ranked in sorted(self.rules.items(), key=lambda item: item[1]):
            made = ranked & ID_MASK
            width = self.length[right]
            depends = max(
                doubt.get(right, 0),
                reach.get(right, 0),
                doubt.get(left, 0) - width,
                reach.get(left, 0) - width,
            )
            doubt[made] = max(doubt.get(made, 0), depends)
            reach[left] = max(reach.get(left, 0), width + doubt.get(right, 0))
            most = max(most, doubt[made], reach[left])
        return most

    def merge(self, tokens: list[int]) -> list[int]:
        """Apply the merges by rank, each from left to right; changes and returns ``tokens``."""

        rule = self.rules.get
        ranked = [rule(pair, NO_RULE) for pair in zip(tokens, tokens[1:])]
        while ranked:
            best = min(ranked)
            if best == NO_RULE:
                break
            at = ranked.index(best)
            tokens[at : at + 2] = [best & ID_MASK]
            del ranked[at]
            if at < len(ranked):
                ranked[at] = rule((tokens[at], tokens[at + 1]), NO_RULE)
            if at:
                ranked[at - 1] = rule((tokens[at - 1], tokens[at]), NO_RULE)
        return tokens


class BatchMerges:
    """The same merges for many short words at once: rows of symbols, one merge per row and step."""

    def __init__(self, merges: Merges) -> None:
        pairs = np.array([[a, b] for a, b in merges.rules], np.int64).reshape(-1, 2)
        keys = pairs[:, 0] << ID_BITS | pairs[:, 1]
        order = np.argsort(keys)
        self._keys = keys[order]
        self._ranked = np.fromiter(merges.rules.values(), np.int64, len(keys))[order]
        self._inner, self._last = np.full(1024, -1, np.int64), np.full(1024, -1, np.int64)
        for code in BYTE_CHARACTERS.values():
            self._inner[code] = merges.ids[chr(code)]
            self._last[code] = merges.ids[chr(code) + merges.suffix]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << ID_BITS | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where((self._keys[at] == keys) & (right >= 0) & (left >= 0), self._ranked[at], NO_RULE)

    def __call__(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word; the words are not empty and of similar length."""

        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max())
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        tokens = np.full((len(words), width + 1), -1, np.int64)
        inside = np.arange(width + 1) < sizes[:, None]
        tokens[inside] = self._inner[codes]
        tokens[np.arange(len(words)), sizes - 1] = self._last[codes[np.cumsum(sizes) - 1]]
        done = tokens.copy()
        rows = np.arange(len(words))
        ranked = self._rank(tokens[:, :-1], tokens[:, 1:])
        columns = np.arange(width + 1)
        while len(rows):
            at = ranked.argmin(axis=1)
            here = np.arange(len(rows))
            best = ranked[here, at]
            stop = best == NO_RULE
            if stop.any():
                done[rows[stop]] = tokens[stop]
                go = ~stop
                rows, tokens, ranked, at, best = (x[go] for x in (rows, tokens, ranked, at, best))
                here = np.arange(len(rows))
                if len(rows) == 0:
                    break
            tokens[here, at] = best & ID_MASK
            source = np.minimum(columns + (columns > at[:, None]), width)
            tokens = np.take_along_axis(tokens, source, axis=1)
            tokens[:, -1] = -1
            source = np.minimum(columns[:-1] + (columns[:-1] > at[:, None]), width - 1)
            ranked = np.take_along_axis(ranked, source, axis=1)
            ranked[:, -1] = NO_RULE
            ranked[here, at] = self._rank(tokens[here, at], tokens[here, at + 1])
            before = np.maximum(at - 1, 0)
            left = self._rank(tokens[here, before], tokens[here, before + 1])
            ranked[here, before] = left
        ends = np.cumsum((done >= 0).sum(axis=1) * 4).tolist()
        packed = done[done >= 0].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]


class WordTransducer:
    """Encodes one word fed in parts; gives out tokens as soon as they are certain."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.block = 2 * (merges.lookahead + merges.longest) + 2
        self.buffer = ""

    def feed(self, characters: str) -> Iterator[int]:
        for start in range(0, len(characters), self.block):
            self.buffer += characters[start : start + self.block]
            yield from self._stable()

    def _stable(self) -> Iterator[int]:
        ids = self.merges.ids
        while len(self.buffer) > self.block:
            seen = self.buffer[: self.block]
            done = 0
            for token in self.merges.merge([ids[c] for c in seen]):
                end = done + self.merges.length[token]
                if end + self.merges.lookahead > len(seen):
                    break
                yield token
                done = end
            self.buffer = self.buffer[done:]

    def finish(self) -> list[int]:
        if not self.buffer:
            return []
        ids, word = self.merges.ids, self.buffer
        self.buffer = ""
        return self.merges.merge([ids[c] for c in word[:-1]] + [ids[word[-1] + self.merges.suffix]])


class Encoder:
    """Texts to ids packed as little-endian 32-bit integers.

    Texts of Latin-1 letters and ASCII signs are split here, others by the library between their
    blanks, which no token spans. The ids of short words are remembered in a map of bounded size.
    Special tokens are cut out first, as the library does.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        self._known: dict[str, bytes] = {}
        self._together = BatchMerges(self.merges)
        self._short = WordTransducer(self.merges).block
        library = Tokenizer.from_file(path)
        self._normalize = library.normalizer.normalize_str
        self._split = library.pre_tokenizer.pre_tokenize_str
        special = {t.content: n for n, t in library.get_added_tokens_decoder().items()}
        self._special_ids = {text: np.array([n], "<u4").tobytes() for text, n in special.items()}
        longest_first = sorted(special, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, each in the characters its bytes stand for,
        or plain where they are ASCII."""

        if LATIN.fullmatch(text):
            return LATIN_WORDS.findall(text.lower())
        parts = (self._split(self._normalize(piece)) for piece in re.split(r"[ \n]+", text))
        return [OTHER + word for found in parts for word, _ in found]

    def _characters(self, word: str) -> str:
        if word.startswith(OTHER):
            return word[len(OTHER) :]
        return word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_CHARACTERS)

    def word(self, characters: str) -> bytes:
        transducer = WordTransducer(self.merges)
        ids = [*transducer.feed(characters), *transducer.finish()]
        return np.array(ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Remember new short words. They fit into a transducer's buffer as a whole, so the merges of
        all of them are done together."""

        if len(self._known) + len(words) > MAX_CACHED_WORDS:
            self._known.clear()
        sized: dict[int, list[tuple[str, str]]] = {}
        for word in words:
            characters = self._characters(word)
            if len(characters) <= self._short:
                sized.setdefault((len(characters) + 3) // 4, []).append((word, characters))
        for group in sized.values():
            for start in range(0, len(group), BATCH_WORDS):
                part = group[start : start + BATCH_WORDS]
                self._known.update(zip([w for w, _ in part], self._together([c for _, c in part])))

    def _ids(self, word: str) -> bytes:
        found = self._known.get(word)
        return self.word(self._characters(word)) if found is None else found

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Packed ids of each text."""

        split = [self._special.split(text) if "<|" in text else [text] for text in texts]
        found = [
            [[part] if i % 2 else self.words(part) for i, part in enumerate(parts)] for parts in split
        ]
        known = self._known
        fresh = {w for parts in found for words in parts[::2] for w in words if w not in known}
        if len(known) + len(fresh) > MAX_CACHED_WORDS:
            fresh = {w for parts in found for words in parts[::2] for w in words}
        self._learn(fresh)
        for parts in found:
            yield b"".join(
                self._special_ids[words[0]] if i % 2 else self._join(words) for i, words in enumerate(parts)
            )

    def _join(self, words: list[str]) -> bytes:
        try:
            return b"".join([self._known[word] for word in words])
        except KeyError:  # a word too long to be remembered
            return b"".join([self._ids(word) for word in words])

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


class Decoder:
    """Ids to text, part by part: token bytes go through an incremental UTF-8 machine.

    Without a decoder in the vocabulary file the library joins tokens by blanks; ``separator`` says so.
    """

    def __init__(self, tokens: dict[int, bytes], separator: bytes = b" ") -> None:
        self.tokens, self.separator = tokens, separator
        self._started = False
        self._machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        data = self.separator.join(map(self.tokens.__getitem__, ids))
        if self._started and data:
            data = self.separator + data
        self._started = self._started or bool(data)
        return self._machine.decode(data)

    def finish(self) -> str:
        return self._machine.decode(b"", final=True)


def token_bytes(path: str) -> dict[int, bytes]:
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    return {number: token.encode("utf-8") for token, number in vocabulary.items()}


_encoders: dict[str, Encoder] = {}


def shared_encoder(path: str) -> Encoder:
    """One encoder per Python worker, kept between tasks."""

    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _round_trip(path: str, outputs: bool) -> Callable:
    fields = [
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_sha256", pa.string()),
        ("decoded_sha256", pa.string()),
    ]
    if outputs:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = shared_encoder(path), token_bytes(path)
        for batch in batches:
            for part, texts in slices(batch, "_text", BATCH_BYTES):
                out: dict[str, list] = {name: [] for name in schema.names}
                out["doc_id"] = part.column("doc_id").to_pylist()
                for packed in encoder.encode_all(texts):
                    ids = np.frombuffer(packed, "<u4")
                    decoder, digest, pieces = Decoder(tokens), hashlib.sha256(), []
                    for start in range(0, len(ids), 1 << 16):
                        piece = decoder.feed(ids[start : start + (1 << 16)].tolist())
                        digest.update(piece.encode("utf-8"))
                        if outputs:
                            pieces.append(piece)
                    last = decoder.finish()
                    digest.update(last.encode("utf-8"))
                    out["n_tokens"].append(len(ids))
                    out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                    out["decoded_sha256"].append(digest.hexdigest())
                    if outputs:
                        out["ids"].append(ids.astype(np.int32))
                        out["decoded"].append("".join(pieces) + last)
                yield record_batch(out, schema)

    return run


def encode_decode(docs: DataFrame, path: str | None = None, outputs: bool = True) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256, and with
    ``outputs`` the ids and the decoded text.

    Map-only, one row out per row in. A null text is empty and has no tokens; repeated rows give
    repeated rows; other columns are ignored. ``path`` must be readable where tasks run.
    """

    prepare(docs.sparkSession)
    extra = ", ids array<int>, decoded string" if outputs else ""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text")
    ).mapInArrow(
        _round_trip(path or vocabulary_path(), outputs),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + extra,
    )
