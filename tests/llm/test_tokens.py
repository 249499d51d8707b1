import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from embedlab.llm.bpe import Decoder, Encoder, Merges, WordTransducer, encode_decode, token_bytes, vocabulary_path
from embedlab.llm.packing import pack_documents, pack_items, sum_of_squares
from embedlab.llm.queries import QUERIES

LIBRARY = Tokenizer.from_file(vocabulary_path())
SCHEMA = "doc_id long, text string, _text string, IDS int"
ODD = [
    None, "", " ", "\n\n", "Hello World's", "it'S  ünïcode\x85x\x1cy z", "日本語 テスト 😀é",
    "<|endoftext|>a<|startoftext|>", "<|endof", "ΣΑΣ İ ǅ", "ab" * 5000, "a" * 3000 + "é" * 3000, "1234 ½²",
]


def _ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def _frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], SCHEMA)


def test_round_trip_against_the_library(spark):
    rows = {r.doc_id: r for r in encode_decode(_frame(spark, ODD + ODD[:3])).collect()}
    for i, text in enumerate(ODD + ODD[:3]):
        ids = _ids(text)
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded == LIBRARY.decode(ids, skip_special_tokens=False)
        assert rows[i].decoded_sha256 == hashlib.sha256(rows[i].decoded.encode()).hexdigest()


def test_query_against_the_library(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in QUERIES["op7_bpe"](spark, folder).collect()}
    assert len(rows) == len(docs)
    for doc, text in docs:
        packed = np.array(_ids(text), "<u4").tobytes()
        assert rows[doc].ids_sha256 == hashlib.sha256(packed).hexdigest()


def test_random_texts_and_stable_tokens():
    encoder, rng = Encoder(vocabulary_path()), random.Random(3)
    tokens = [t.removesuffix("</w>") for t in encoder.merges.ids if t.isascii()]
    for _ in range(400):
        word = "".join(rng.choice(tokens) for _ in range(rng.randrange(1, 120)))
        letters = "".join(c for c in word if c.isalpha()).lower() or "a"
        assert np.frombuffer(encoder.encode(word), "<u4").tolist() == _ids(word)
        transducer, out = WordTransducer(encoder.merges), []
        for start in range(0, len(letters), 7):
            out.extend(transducer.feed(letters[start : start + 7]))
            assert len(transducer.buffer) <= transducer.block + 7
        assert out + transducer.finish() == _ids(letters)


def test_lookahead_is_found_from_the_merges(tmp_path):
    assert 1 <= Merges(vocabulary_path()).lookahead < 100


def test_decoder_in_parts():
    ids = _ids("Zwölf Boxkämpfer 😀 jagen")
    decoder = Decoder(token_bytes(vocabulary_path()))
    parts = "".join(decoder.feed([i]) for i in ids) + decoder.finish()
    assert parts == LIBRARY.decode(ids, skip_special_tokens=False)


def _check_packing(rows, texts, capacity):
    documents, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        documents[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, text in texts.items():
        ids = np.array(_ids(text) + [0], "<u4")
        pieces = sorted(documents.pop(doc), key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(-(-len(ids) // capacity)))
        for r in pieces:
            part = ids[r.start : r.start + r.length]
            assert r.start == r.piece * capacity and r.length == len(part)
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
    assert not documents
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(sequences), -(-sum(r.length for r in rows) // capacity)


def test_packing_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    used, least = _check_packing(
        QUERIES["op5_best_fit_packing"](spark, folder).collect(), {d: t for d, t in docs}, 2048
    )
    assert used <= least * 1.05 + 1


def test_packing_odd_texts(spark):
    rows = pack_documents(_frame(spark, ODD), 64).collect()
    _check_packing(rows, dict(enumerate(ODD)), 64)
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (5, None), (5, None)], "doc_id long, text string")
    assert len(pack_documents(twice).collect()) == 4
    assert pack_documents(twice.limit(0)).count() == 0


def test_groups_are_packed_again(spark):
    items = spark.range(9000).selectExpr("id as _item", "1 + pmod(hash(id), 50) as _size")
    rows = items.join(pack_items(items, 64), "_item").collect()
    filled = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r._size
    assert max(filled.values()) <= 64
    assert len(filled) <= 1.02 * sum(r._size for r in rows) / 64 + 2


def test_each_placement_is_the_best():
    rng = np.random.default_rng(2)
    capacity = 12
    sizes = rng.integers(1, capacity + 1, 200)
    bins, offsets = sum_of_squares(sizes, capacity)
    gaps = []
    for size, chosen, offset in zip(sizes, bins, offsets):
        def cost(state):
            counts = np.bincount([g for g in state if g], minlength=capacity + 1)
            return int((counts**2).sum())

        options = [cost([g - size if i == j else g for j, g in enumerate(gaps)]) for i, g in enumerate(gaps) if g >= size]
        options.append(cost(gaps + [capacity - size]))
        if chosen == len(gaps):
            gaps.append(capacity)
        assert offset == capacity - gaps[chosen]
        gaps[chosen] -= size
        assert cost(gaps) == min(options)
