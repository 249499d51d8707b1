"""Restoring disguised words: a character lattice per suspicious span, decoded with a character model.

A span is a word with digits or symbols among its letters, a word with a letter three times in a row, or
a run of single characters set apart. Each of its characters can be read in several ways: itself, the
letter it stands for, shorter repetitions, a gap or nothing. Every reading has a cost; Viterbi finds the
reading with the best sum of channel and character probabilities. Other text is left as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ORDER = 4
SYMBOLS = 40
CELLS = SYMBOLS**ORDER
BOUNDARY = 0
SMOOTHING = 6.0
#: longer spans are decoded window by window
WINDOW_UNITS = 64
CACHE = 200_000

# fixed values: letters that digits and symbols stand for
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "¡": "i", "£": "l", "¥": "y",
}

# log costs of the channel
SUBSTITUTED = -1.5
SHORTENED = -0.3
DOUBLED_SHORTENED = -3.0
KEPT_LONG = -6.0
GAP_REMOVED = -0.5
GAP_KEPT = -1.0

_SIGN = "".join(re.escape(c) for c in STANDS_FOR)
_CHAR = rf"(?:[^\W_]|[{_SIGN}])"
_GAP = r"[ .\-_*~·]{1,3}"
_SPACED = re.compile(rf"(?<![\w{_SIGN}])[^\W_](?:{_GAP}{_CHAR}(?![\w{_SIGN}])){{3,}}")
_WORD = re.compile(rf"{_CHAR}*[^\W\d_]{_CHAR}*")
_HINT = re.compile(rf"[^\W\d_][{_SIGN}]|[{_SIGN}][^\W\d_]|([^\W\d_])\1\1")
_LETTER = re.compile(r"[^\W\d_]")


def _symbol_table() -> np.ndarray:
    table = np.zeros(0x10000, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        if "a" <= c <= "z":
            table[i] = i - 96
        elif c.isalpha():
            table[i] = 27 + i % (SYMBOLS - 27)
    return table


_TABLE = _symbol_table()


def symbols(text: str) -> np.ndarray:
    """Symbol of every character: 1 to 26 for a to z, other letters folded into the rest, 0 for anything else."""

    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(points, 0xFFFF)]


def count_cells(texts: list[str | None]) -> np.ndarray:
    """Counts of all windows of four symbols; whatever lies between words counts as one boundary."""

    joined = symbols(" ".join(t.lower() for t in texts if t) + " ")
    keep = np.concatenate(([True], (joined[1:] > 0) | (joined[:-1] > 0)))
    codes = joined[keep].astype(np.int64)
    if len(codes) < ORDER:
        return np.zeros(0, np.int64)
    cell = codes[: 1 - ORDER].copy()
    for i in range(1, ORDER):
        cell *= SYMBOLS
        cell += codes[i : len(codes) - ORDER + 1 + i]
    return cell


def cell_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function from (text) to (cell, n): one dense table per task, its filled cells at the end."""

    total = np.zeros(CELLS, np.int64)
    for batch in batches:
        cells = count_cells(batch.column("text").to_pylist())
        if len(cells) > CELLS // 16:
            total += np.bincount(cells, minlength=CELLS)
        else:
            np.add.at(total, cells, 1)
    filled = np.flatnonzero(total)
    for at in range(0, len(filled), 1 << 16):
        part = filled[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["cell", "n"])


class CharacterModel:
    """Smoothed log probabilities of a symbol after one, two and three others."""

    def __init__(self, counts: np.ndarray):
        four = counts.astype(np.float64).reshape((SYMBOLS,) * ORDER)
        below = np.full(SYMBOLS, 1.0 / SYMBOLS)
        self.log: list[np.ndarray] = []
        for known in range(ORDER):
            n = four.sum(axis=tuple(range(ORDER - 1 - known)))
            p = (n + SMOOTHING * below) / (n.sum(axis=-1, keepdims=True) + SMOOTHING)
            below = p
            self.log.append(np.log(p).astype(np.float32).reshape(-1, SYMBOLS))

    def cost(self, before: tuple[int, ...], symbol: int) -> float:
        row = 0
        for s in before:
            row = row * SYMBOLS + s
        return float(self.log[len(before)][row, symbol])


def units(span: str) -> list[tuple[str, int]]:
    """Runs of one character: (character, how often). A gap is one unit of a blank."""

    out: list[tuple[str, int]] = []
    for c in span:
        if not (c.isalnum() or c in STANDS_FOR):
            c = " "
        if out and out[-1][0] == c:
            out[-1] = (c, out[-1][1] + 1)
        else:
            out.append((c, 1))
    return out


def readings(char: str, times: int, spaced: bool) -> list[tuple[str, float]]:
    """(text, log cost) of every reading of a unit."""

    if char == " ":
        return [(" ", GAP_KEPT), ("", GAP_REMOVED)] if spaced else [(" ", 0.0)]
    letters = [(char, 0.0)] if char.isalpha() else [(c, SUBSTITUTED) for c in STANDS_FOR.get(char, "")]
    out = []
    for letter, cost in letters:
        if times == 1:
            out.append((letter, cost))
        elif times == 2:
            out += [(letter * 2, cost), (letter, cost + DOUBLED_SHORTENED)]
        else:
            out += [(letter, cost + SHORTENED), (letter * 2, cost + SHORTENED), (letter * times, cost + KEPT_LONG)]
    if not char.isalpha():
        out.append((char * times, 0.0))
    return out


def lattice(span: str, spaced: bool) -> list[list[tuple[str, float]]]:
    return [readings(c, n, spaced) for c, n in units(span)]


def best_reading(model: CharacterModel, steps: list[list[tuple[str, float]]]) -> tuple[str, float]:
    """The reading of the highest log probability between two boundaries, and that probability."""

    states: dict[tuple[int, ...], tuple[float, object]] = {(BOUNDARY,): (0.0, None)}
    for options in steps:
        prepared = [(text, cost, _TABLE_OF(text)) for text, cost in options]
        after: dict[tuple[int, ...], tuple[float, object]] = {}
        for before, (value, path) in states.items():
            for text, cost, codes in prepared:
                state, total = before, value + cost
                for code in codes:
                    if code == BOUNDARY and state[-1] == BOUNDARY:
                        continue
                    total += model.cost(state, code)
                    state = (*state, code)[1 - ORDER :]
                if state not in after or total > after[state][0]:
                    after[state] = (total, (path, text))
        states = after
    best, chosen = -np.inf, None
    for state, (value, path) in states.items():
        total = value if state[-1] == BOUNDARY else value + model.cost(state, BOUNDARY)
        if total > best:
            best, chosen = total, path
    parts = []
    while chosen is not None:
        chosen, text = chosen
        parts.append(text)
    return "".join(reversed(parts)), best


def _TABLE_OF(text: str) -> list[int]:
    return [int(_TABLE[min(ord(c), 0xFFFF)]) for c in text]


class Restorer:
    """Restores texts with a character model; remembers the spans it has decoded."""

    def __init__(self, model: CharacterModel):
        self.model = model
        self.seen: dict[tuple[str, bool], str] = {}

    def decode(self, span: str, spaced: bool) -> str:
        known = self.seen.get((span, spaced))
        if known is None:
            steps = lattice(span, spaced)
            pieces = [steps[i : i + WINDOW_UNITS] for i in range(0, len(steps), WINDOW_UNITS)]
            known = "".join(best_reading(self.model, piece)[0] for piece in pieces)
            if len(span) <= 4 * WINDOW_UNITS:
                if len(self.seen) >= CACHE:
                    self.seen.clear()
                self.seen[span, spaced] = known
        return known

    def _spaced(self, match: re.Match) -> str:
        span = match.group()
        if not _LETTER.search(span):
            return span
        size = 2 * WINDOW_UNITS
        if len(span) <= size:
            return self.decode(span, True)
        return "".join(self.decode(span[i : i + size], True) for i in range(0, len(span), size))

    def _word(self, match: re.Match) -> str:
        token = match.group()
        if not _HINT.search(token):
            return token
        # punctuation at the end is not part of the word
        core = token.rstrip("!|+")
        return self.decode(core, False) + token[len(core) :] if _HINT.search(core) else token

    def __call__(self, text: str | None) -> str:
        """The lower-cased text with its disguised words restored."""

        text = (text or "").lower()
        text = _SPACED.sub(self._spaced, text)
        return _WORD.sub(self._word, text) if _HINT.search(text) else text
