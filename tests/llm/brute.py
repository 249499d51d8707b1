"""Plain-Python versions of the text operators."""

import hashlib
from collections import defaultdict


def sha(data):
    return hashlib.sha256(data).hexdigest()


def _kept(items, gone):
    return [x for x, g in zip(items, gone) if not g]


def substring_dedup(rows, length):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    rank = lambda d: (1, 0) if d is None else (0, d)
    owner = {}
    for d, w in words:
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            owner[key] = min(owner.get(key, rank(d)), rank(d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if owner[tuple(w[i : i + length])] < rank(d):
                gone[i : i + length] = [True] * length
        out.append((d, len(w), sum(gone), sha(b" ".join(_kept(w, gone)))))
    return out


def suffix_dedup(rows, length, keep_first):
    texts = [(d, (t or "").encode()) for d, t in rows]
    order = sorted(range(len(texts)), key=lambda i: (texts[i][0] is None, texts[i][0] or 0))
    places = defaultdict(list)
    for i in order:
        for p in range(len(texts[i][1]) - length + 1):
            places[texts[i][1][p : p + length]].append((i, p))
    gone = [bytearray(len(t)) for _, t in texts]
    for found in places.values():
        if len(found) > 1:
            for i, p in found[1:] if keep_first else found:
                gone[i][p : p + length] = b"\x01" * length
    out = []
    for (d, t), g in zip(texts, gone):
        spans = sum(1 for i in range(len(g)) if g[i] and (i == 0 or not g[i - 1]))
        out.append((d, len(t), sum(g), spans, sha(bytes(_kept(t, g)))))
    return out
