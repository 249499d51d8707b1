"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

Text is cut into islands, the only places where an entity can be (they hold digits in number, four
parts joined by dots, an ``@`` or a spelled-out one). In an island every span of up to ``MAX_TOKENS`` tokens is a candidate for
every kind, scored by features of the whole span; forward-backward trains the weights and a Viterbi
pass picks boundaries and kinds together. Spans of the fixed patterns always stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedlab.llm.rows import free_name, prepare, record_batch, slices

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 24
SAMPLE_ISLANDS = 300
BATCH_BYTES = 4 << 20

# fixed values: the patterns, each with the same leftmost matches as its plain form and linear time
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

NUMBERS = re.compile(r"[+(]?[0-9](?:[ ().\[\]/,:+-]{0,3}[0-9])++")
PARTS = re.compile(r"(?<![0-9])[0-9]++(?:\[?\.\]?[0-9]++){3,}+")
SPELLED = re.compile(r"(?i:[(\[{]at[)\]}]| dot )")
SPELLED_EMAIL = re.compile(
    r"[A-Za-z0-9._%+-]{1,64} ?(?i:[(\[{]at[)\]}]| at ) ?[A-Za-z0-9-]{1,63}"
    r"(?: ?(?i:\.|[(\[{]dot[)\]}]| dot ) ?[A-Za-z0-9-]{1,63}){1,8}"
)
SPELLED_WINDOW = 160
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\s0-9A-Za-z]")
AT = re.compile(r"@|(?i:[(\[{]at[)\]}]| at )")
DOT = re.compile(r"\.|(?i:[(\[{]dot[)\]}]| dot )")
FOUR_PARTS = re.compile(r"([0-9]{1,3})\[?\.\]?([0-9]{1,3})\[?\.\]?([0-9]{1,3})\[?\.\]?([0-9]{1,3})")
DATE = re.compile(r"(?:[0-9]{4}([-./])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./])[0-9]{1,2}\2[0-9]{2,4})\b.*")
CONTEXT = {
    "email": re.compile(r"mail", re.I),
    "ip": re.compile(r"\bip\b|address|host", re.I),
    "card": re.compile(r"card|visa|credit|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"tel|phone|call|fax|mobil|ruf", re.I),
}

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end(), "email"
            free = host.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start and then by kind."""

    found = list(_emails(text)) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def islands(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Maximal ranges that can hold entities: patterns, digit runs, four parts or more joined by ``.``
    or ``[.]`` whatever their digits, and addresses spelled out in either case."""

    found = [(s, e) for s, e, _ in base]
    if DIGIT.search(text):
        for m in NUMBERS.finditer(text):
            if m.end() - m.start() >= 7 and len(_digits(m[0])) >= 7:
                end = m.end() + 1 if text[m.end() : m.end() + 1] == ")" else m.end()
                found.append((m.start(), end))
        found += [m.span() for m in PARTS.finditer(text)]
    for m in SPELLED.finditer(text):
        low = max(0, m.start() - SPELLED_WINDOW)
        for address in SPELLED_EMAIL.finditer(text, low, m.end() + SPELLED_WINDOW):
            found.append(address.span())
    merged: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if merged and start < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def span_features(text: str, start: int, end: int) -> np.ndarray:
    span, digits = text[start:end], _digits(text[start:end])
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    at = AT.search(span)
    host = span[at.end() :] if at else ""
    parts = FOUR_PARTS.fullmatch(span)
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    near = text[max(0, start - 24) : start]
    letters = any(c.isalpha() for c in span)
    card_size = 12 <= len(digits) <= 19
    return np.array(
        [
            1.0,
            9 <= len(digits) <= 15 and not letters,
            card_size and not letters,
            len(digits) in (10, 11) and not letters,
            card_size and not letters and luhn(digits),
            card_size and not letters and not luhn(digits),
            bool(parts) and all(int(p) <= 255 for p in parts.groups()),
            bool(at) and at.start() > 0,
            bool(at) and bool(DOT.search(host)) and host[-1:].isalnum(),
            bool(at) and host[-2:].isalpha(),
            span[:1] == "+",
            bool(re.match(r"(\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)", span)),
            groups[-3:] == [3, 3, 4],
            groups in ([4, 4, 4, 4], [16], [15], [4, 6, 5]),
            before.isalnum(),
            after.isalnum(),
            before in ("+", "(", "@", ".", "-"),
            bool(DATE.fullmatch(span)),
            len(groups) == 1,
            bool(re.search(r"[,:/]", span)),
            len(groups) > 5,
            letters and not at,
            span.count("(") != span.count(")"),
            len(digits) < 9 and not letters,
            span[-1:] in "([+-." or span[:1] in ").-,:/",
            *(bool(CONTEXT[kind].search(near)) for kind in KINDS),
        ],
        dtype=float,
    )


N_FEATURES = len(span_features("0", 0, 1))


class Island:
    """Tokens of a range and all its candidate segments with their features."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.tokens = [m.span() for m in TOKEN.finditer(text, start, end)]
        self.segments = [
            (i, j)
            for i in range(len(self.tokens))
            for j in range(i + 1, min(i + MAX_TOKENS, len(self.tokens)) + 1)
            if self._possible(text, self.tokens[i][0], self.tokens[j - 1][1])
        ]
        rows = [span_features(text, self.tokens[i][0], self.tokens[j - 1][1]) for i, j in self.segments]
        self.features = np.array(rows).reshape(len(rows), N_FEATURES)

    @staticmethod
    def _possible(text: str, start: int, end: int) -> bool:
        if text[end - 1] not in ")" and not text[end - 1].isalnum():
            return False
        span = text[start:end]
        return (text[start].isalnum() or text[start] in "+(") and (
            len(_digits(span)) >= 4 or AT.search(span) is not None
        )


def log_partition(
    island: Island, scores: np.ndarray
) -> tuple[float, np.ndarray]:
    """Log of the sum over all segmentations, and the probability of each (segment, kind).

    A token outside an entity scores 0.
    """

    n = len(island.tokens)
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0] = backward[n] = 0.0
    mass = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.empty(0)
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    begins: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (i, j) in enumerate(island.segments):
        ends[j].append(s)
        begins[i].append(s)
    for t in range(1, n + 1):
        terms = [forward[t - 1]] + [forward[island.segments[s][0]] + mass[s] for s in ends[t]]
        forward[t] = np.logaddexp.reduce(terms)
    for t in range(n - 1, -1, -1):
        terms = [backward[t + 1]] + [backward[island.segments[s][1]] + mass[s] for s in begins[t]]
        backward[t] = np.logaddexp.reduce(terms)
    outside = np.array([forward[i] + backward[j] for i, j in island.segments]).reshape(-1, 1)
    return float(forward[n]), np.exp(scores + outside - forward[n]) if len(scores) else scores


def best_segmentation(island: Island, scores: np.ndarray) -> list[Span]:
    """The entities of the best segmentation, as token ranges with kinds."""

    n = len(island.tokens)
    value, back = np.zeros(n + 1), [None] * (n + 1)
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (_, j) in enumerate(island.segments):
        ends[j].append(s)
    top = scores.argmax(axis=1) if len(scores) else []
    for t in range(1, n + 1):
        value[t] = value[t - 1]
        for s in ends[t]:
            i = island.segments[s][0]
            total = value[i] + scores[s, top[s]]
            if total > value[t]:
                value[t], back[t] = total, (i, s)
    found, t = [], n
    while t > 0:
        if back[t] is None:
            t -= 1
        else:
            i, s = back[t]
            found.append((island.tokens[i][0], island.tokens[t - 1][1], KINDS[top[s]]))
            t = i
    return found[::-1]


def _known(text: str) -> list[Span]:
    """The spans of the fixed patterns and bracketed addresses, which a text must not teach to be none."""

    found = base_spans(text)
    for m in PARTS.finditer(text):
        parts = FOUR_PARTS.fullmatch(m[0]) if "[" in m[0] or "]" in m[0] else None
        if parts and all(int(p) <= 255 for p in parts.groups()):
            found.append((m.start(), m.end(), "ip"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _examples(rng: np.random.Generator, words: list[str]) -> Iterator[tuple[str, list[Span]]]:
    """Made-up texts with known entities, in forms the fixed patterns take or miss, and look-alikes."""

    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *options: options[rng.integers(len(options))]
    around = lambda: " ".join(pick(*words) for _ in range(3))
    short = np.random.default_rng(12)
    for _ in range(60):
        name, host = pick(*words) + pick("", "." + number(2)), pick(*words) + pick("", number(1))
        top = pick("com", "org", "net", "example.com", "de")
        area, middle, last = number(3), number(3), number(4)
        card = number(15)
        card += next(d for d in "0123456789" if luhn(card + d))
        quads = [card[i : i + 4] for i in range(0, 16, 4)]
        octets = [str(x) for x in rng.integers(1, 256, 4)]
        spelled = pick(" at ", "[at]", " (at) ", "(at)")
        dotted = pick(" dot ", "[dot]", ".")
        if spelled == " at ":
            dotted = " dot "
        positives = [
            ("email", f"{name}@{host}.{top}"),
            ("email", f"{name}{spelled}{host}{dotted}{top.replace('.', dotted)}"),
            ("email", f"{pick(*words)}{pick('[at]', '(at)')}{pick(*words)}{pick('[dot]', '.')}{pick('com', 'org', 'net')}"),
            ("ip", ".".join(octets)),
            ("ip", "[.]".join(octets)),
            *(("ip", "[.]".join(str(x) for x in short.integers(0, high, 4))) for high in (10, 100, 256)),
            ("card", pick("", " ", "-").join(quads)),
            ("phone", f"+{pick('1', '44', '49')} ({area}) {middle}-{last}"),
            ("phone", f"({area}) {middle}-{last}"),
            ("phone", pick("-", ".").join((area, middle, last))),
        ]
        for kind, entity in positives:
            lead = around() + pick("", f" {kind}", " call", " tel:") + " "
            yield lead + entity + pick(" ", ". ", ", ") + around(), [(len(lead), len(lead) + len(entity), kind)]
        wrong = card[:-1] + str((int(card[-1]) + 1 + rng.integers(0, 9)) % 10)
        negatives = [
            pick(number(7), number(8), wrong),
            f"{2000 + rng.integers(0, 25)}-{rng.integers(10, 13)}-{rng.integers(10, 29)} {number(2)}:{number(2)}",
            f"{rng.integers(1, 29)}.{rng.integers(1, 13)}.{rng.integers(1990, 2030)}",
            f"{rng.integers(1, 999)},{number(3)},{number(3)}.{number(2)}",
            "abcdef"[rng.integers(6)] + number(12) + "bc" + number(9),
            f"{number(1)}.{number(2)}.{number(4)}.{number(5)}",
            f"{pick(*words)} at {pick(*words)} dot",
            " ".join(number(rng.integers(1, 3)) for _ in range(8)),
            number(9), number(10), number(12), number(20),
            "-".join(number(rng.integers(2, 6)) for _ in range(4)),
        ]
        for text in negatives:
            lead = around() + " "
            yield lead + text + pick(" ", ". ") + around(), base_spans(lead + text + " ")


def _sample_islands(seed: int) -> Callable:
    schema = pa.schema([("text", pa.string()), ("order", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, "text", BATCH_BYTES):
                found = []
                for text in texts:
                    for start, end in islands(text, base_spans(text)):
                        if end - start <= 200:
                            found.append(text[max(0, start - 40) : end + 20])
                digests = [hashlib.sha256(f"{seed}{x}".encode()).digest()[:8] for x in found]
                order = [int.from_bytes(d, "big", signed=True) for d in digests]
                yield record_batch({"text": found, "order": order}, schema)

    return cut


def train_spans(docs: DataFrame, sample_islands: int = SAMPLE_ISLANDS, steps: int = 60) -> np.ndarray:
    """Weights (kind, feature), fitted to made-up examples and to at most ``sample_islands`` islands
    of the texts, chosen by hash, whose entities are those of the fixed patterns and bracketed addresses."""

    prepare(docs.sparkSession)
    cut = docs.where(F.col("text").isNotNull()).select("text").mapInArrow(
        _sample_islands(1), "text string, order long"
    )
    sample = [r["text"] for r in cut.orderBy("order", "text").limit(sample_islands).collect()]
    rng = np.random.default_rng(11)
    words = sorted({w.lower() for t in sample for w in re.findall(r"[A-Za-z]{3,12}", t)}) or ["alpha", "beta"]
    examples = [(t, _known(t)) for t in sample] + list(_examples(rng, words))
    rows = []
    for text, gold in examples:
        for start, end in islands(text, base_spans(text)):
            island = Island(text, start, end)
            truth = np.zeros((len(island.segments), len(KINDS)))
            where = {(island.tokens[i][0], island.tokens[j - 1][1]): s for s, (i, j) in enumerate(island.segments)}
            taken = -1
            for a, b, kind in gold:
                if (a, b) in where and a >= taken:
                    truth[where[a, b], KINDS.index(kind)] = 1.0
                    taken = b
            if len(island.segments):
                rows.append((island, truth))
    weights = np.zeros((len(KINDS), N_FEATURES))
    weights[:, 0] = -2.0
    past = np.full_like(weights, 1e-6)
    for _ in range(steps):
        slope = -0.02 * weights
        for island, truth in rows:
            _, probability = log_partition(island, island.features @ weights.T)
            slope += (truth - probability).T @ island.features
        past += slope * slope
        weights += 0.5 * slope / np.sqrt(past)
    return weights


def find_spans(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """(spans of the fixed patterns, all spans): what the model adds never overlaps the former."""

    base = base_spans(text)
    fixed = {(s, e): kind for s, e, kind in base}
    added = []
    for start, end in islands(text, base):
        if (start, end) in fixed and not AT.search(text, start, end):
            continue  # the pattern fills its island
        island = Island(text, start, end)
        scores = island.features @ weights.T
        for s, (i, j) in enumerate(island.segments):
            a, b = island.tokens[i][0], island.tokens[j - 1][1]
            kind = fixed.get((a, b))
            if kind:
                scores[s, KINDS.index(kind)] += 1e6
            elif any(a < e and x < b for x, e in fixed):
                scores[s] = -1e6
        added += [s for s in best_segmentation(island, scores) if not any(s[0] < e and x < s[1] for x, e in fixed)]
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Every span replaced by its kind in brackets; of overlapping spans the union goes once."""

    merged: list[Span] = []
    for start, end, kind in spans:
        if merged and start < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]), merged[-1][2])
        else:
            merged.append((start, end, kind))
    cuts = [0, *(x for s, e, _ in merged for x in (s, e)), len(text)]
    pieces = [text[a:b] for a, b in list(pairwise(cuts))[::2]]
    marks = [f"[{kind.upper()}]" for _, _, kind in merged] + [""]
    return "".join(x for piece in zip(pieces, marks) for x in piece)


def _finder(broadcast) -> Callable:
    schema = pa.schema(
        [("doc_id", pa.int64()), *((f"n_{kind}", pa.int64()) for kind in KINDS)]
        + [("base_sha256", pa.string()), ("spans", pa.string()), ("redacted", pa.string())]
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = broadcast.value
        for batch in batches:
            for part, texts in slices(batch, "_text", BATCH_BYTES):
                out: dict[str, list] = {name: [] for name in schema.names}
                out["doc_id"] = part.column("doc_id").to_pylist()
                for text in texts:
                    base, spans = find_spans(text, weights)
                    for kind in KINDS:
                        out[f"n_{kind}"].append(sum(s[2] == kind for s in base))
                    out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    out["spans"].append(_joined(spans))
                    out["redacted"].append(redact(text, spans) if spans else text)
                yield record_batch(out, schema)

    return find


def find_personal_data(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (fixed patterns), base_sha256 of the fixed
    patterns' spans, all spans as ``kind:start:end`` in code points, and the redacted text.

    A null text is empty. Null and repeated ids need no care, as every row stands alone; other
    columns are ignored. Time is linear in the length of a text.
    """

    spark = docs.sparkSession
    prepare(spark)
    weights = train_spans(docs) if weights is None else weights
    counts = ", ".join(f"n_{kind} long" for kind in KINDS)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text")
    ).mapInArrow(
        _finder(spark.sparkContext.broadcast(weights)),
        f"doc_id long, {counts}, base_sha256 string, spans string, redacted string",
    )


def redact_documents(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; null texts stay null, other columns stay."""

    spark = docs.sparkSession
    prepare(spark)
    weights = train_spans(docs) if weights is None else weights
    broadcast = spark.sparkContext.broadcast(weights)
    flagged = free_name(docs, "_clean")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text", BATCH_BYTES):
                values = [
                    t if t is None else redact(t, find_spans(t, broadcast.value)[1]) for t in texts
                ]
                yield part.append_column(flagged, pa.array(values, pa.string()))

    wide = docs.mapInArrow(clean, T.StructType([*docs.schema, T.StructField(flagged, T.StringType())]))
    return wide.withColumn("text", F.col(flagged)).drop(flagged)
