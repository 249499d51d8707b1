import base64
import gzip
import hashlib
from collections import defaultdict

import pytest

from embedlab.llm.archives import BrokenArchive, read_archives, read_records, record_bytes, write_archives
from embedlab.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, _sha1 string, PAYLOAD int"


def _expected(rows):
    groups = defaultdict(list)
    for page, html in rows:
        groups[(html or "").encode()].append(page)
    out = []
    for page, html in rows:
        data = (html or "").encode()
        top = max((p for p in groups[data] if p is not None), default=None)
        revisit = top is not None and page != top
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


NAMES = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _sorted(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=repr)


def test_round_trip_of_odd_pages(spark, tmp_path):
    rows = [(1, "same"), (2, "same"), (3, None), (4, ""), (5, "é\r\n\r\nWARC/1.0\r\n\r\n"), (6, "x" * 3_000_000)]
    rows += [(None, "same"), (None, "alone"), (7, "twice"), (7, "twice"), (8, "twice")]
    pages = spark.createDataFrame([(p, None if p == 1 else f"http://h/{p}\r\nX: y", h, "c", 1) for p, h in rows], SCHEMA)
    archives = write_archives(pages, str(tmp_path), archive_bytes=2000)
    assert archives.count() > 1
    back = read_archives(archives, payloads=True)
    assert _sorted(back) == _expected(rows)
    assert all(r.digest_ok for r in back.collect())
    stored = {r.page_id: r.payload for r in back.where("record_type = 'response'").collect()}
    assert stored[5] == rows[4][1].encode() and stored[6] == rows[5][1].encode()
    for row in archives.collect():
        with gzip.open(row.archive) as file:
            assert file.read().count(b"WARC/1.0\r\nWARC-Type") == row.records


def test_query_against_brute_force(spark, folder):
    rows = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html").collect()
    assert _sorted(QUERIES["op10_web_archives"](spark, folder)) == _expected([tuple(r) for r in rows])


def test_empty_table(spark):
    assert read_archives(write_archives(spark.createDataFrame([], SCHEMA))).count() == 0


def test_damage_is_noticed():
    data = b"".join(record_bytes(i, "u", b"payload" * i, 7 * i, "D", None, False) for i in range(1, 4))
    for size in (1, 7, len(data)):
        chunks = [data[i : i + size] for i in range(0, len(data), size)]
        records = list(read_records(chunks))
        assert [r.payload for r in records] == [b"payload" * i for i in range(1, 4)]
        assert all(r.block_ok for r in records)
    with pytest.raises(BrokenArchive):
        list(read_records([data[:-5]]))
    with pytest.raises(BrokenArchive):
        list(read_records([data, b"garbage that is no gzip member"]))
    plain = b"WARC/1.0\r\nContent-Length: 3\r\nWARC-Block-Digest: sha1:WRONG\r\n\r\nabc\r\n\r\n"
    assert [r.block_ok for r in read_records([gzip.compress(plain)])] == [False]
    for wrong in (plain.replace(b": 3", b": 2"), plain.replace(b": 3", b": 4"), b"no header"):
        with pytest.raises(BrokenArchive):
            list(read_records([gzip.compress(wrong)]))
