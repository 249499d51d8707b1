"""Web archives: one gzip member per record, written by tasks and read back sequentially.

The reader inflates a stream piece by piece, frames records by their content length and checks their
digests. Its memory is one record, whatever the size of an archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlab.llm.rows import kept, prepare, record_batch, slices
from embedlab.session import fresh_path

ARCHIVE_BYTES = 64 << 20
READ_BYTES = 64 << 10
BATCH_BYTES = 4 << 20
CAPTURE_DATE = "2000-01-01T00:00:00Z"
# fixed values of the format
VERSION = b"WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
END_OF_RECORD = b"\r\n\r\n"
PAGE_HEADER, REFERS_HEADER = "X-Page-Id", "X-Refers-To-Page-Id"


class BrokenArchive(ValueError):
    """The bytes are not a sequence of whole records."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool
) -> bytes:
    """One record as a gzip member; a revisit holds the response's headers without its payload."""

    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" f"Content-Length: {size}\r\n\r\n"
    ).encode("ascii")
    block = http if revisit else http + payload
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>",
        "WARC-Date": CAPTURE_DATE,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "WARC-Profile": REVISIT_PROFILE if revisit else None,
        "WARC-Refers-To": (
            f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{digest}')}>" if revisit else None
        ),
        PAGE_HEADER: page_id,
        REFERS_HEADER: refers_to if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers.items() if v is not None)]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + END_OF_RECORD) + packer.flush()


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes
    block_ok: bool


def _parse_headers(lines: list[bytes]) -> dict[str, str]:
    parsed = {}
    for line in lines:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        parsed[name.strip().lower()] = value.strip()
    return parsed


def _members(chunks: Iterable[bytes]) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as an iterator of inflated pieces to be used up in turn."""

    source = iter(chunks)
    rest = b""

    def pieces() -> Iterator[bytes]:
        nonlocal rest
        inflater = zlib.decompressobj(31)
        while not inflater.eof:
            data = inflater.unconsumed_tail or rest or next(source, b"")
            rest = b""
            if not data:
                raise BrokenArchive("the archive ends inside a record")
            try:
                yield inflater.decompress(data, READ_BYTES)
            except zlib.error as error:
                raise BrokenArchive(str(error)) from error
        rest = inflater.unused_data

    while True:
        rest = rest or next(source, b"")
        if not rest:
            return
        yield pieces()


def read_records(chunks: Iterable[bytes]) -> Iterator[Record]:
    """Records of an archive given as consecutive chunks of bytes."""

    for member in _members(chunks):
        buffer = bytearray()
        while (end := buffer.find(END_OF_RECORD)) < 0:
            piece = next(member, None)
            if piece is None:
                raise BrokenArchive("a record without a header")
            buffer += piece
        lines = bytes(buffer[:end]).split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise BrokenArchive("not an archive record")
        headers = _parse_headers(lines[1:])
        length = int(headers["content-length"])
        block = buffer[end + 4 :]
        for piece in member:
            block += piece
            if len(block) > length + len(END_OF_RECORD):
                raise BrokenArchive("a record is longer than it says")
        if len(block) != length + len(END_OF_RECORD) or not block.endswith(END_OF_RECORD):
            raise BrokenArchive("a record is shorter than it says")
        block = bytes(block[:length])
        named = headers.get("warc-block-digest")
        head, _, payload = block.partition(END_OF_RECORD)
        yield Record(
            headers,
            _parse_headers(head.split(b"\r\n")[1:]),
            payload,
            named is None or named == f"sha1:{base32_sha1(block)}",
        )


def _writer(folder: str, archive_bytes: int) -> Callable:
    schema = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pa.fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        stream, name, records, size = None, "", 0, 0
        for batch in batches:
            for part, payloads in slices(batch, "_payload", BATCH_BYTES):
                columns = [part.column(c).to_pylist() for c in ("page_id", "url", "_size", "_sha1", "_keep", "_revisit")]
                for payload, page, url, length, sha1, keep, revisit in zip(payloads, *columns):
                    if stream is None:
                        # a fresh name per attempt: files of lost attempts are never listed
                        name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        stream = system.open_output_stream(f"{root}/{name}", compression=None)
                    digest = base64.b32encode(sha1).decode("ascii")
                    data = record_bytes(page, url, payload, length, digest, keep, revisit)
                    stream.write(data)
                    records, size = records + 1, size + len(data)
                    if size >= archive_bytes:
                        stream.close()
                        stream = None
                        yield record_batch({"archive": [f"{folder}/{name}"], "records": [records], "bytes": [size]}, schema)
        if stream is not None:
            stream.close()
            yield record_batch({"archive": [f"{folder}/{name}"], "records": [records], "bytes": [size]}, schema)

    return write


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page and return the archives: archive (path), records, bytes.

    Of pages with equal payloads, empty ones included, the one with the largest page_id is a response
    and the others are revisits that refer to it. Null ids rank below all others; where all are null,
    and for rows equal in id and payload, each is a response of its own. A null html is an empty
    payload, a null url is left out; other columns are ignored. Each task writes its own files, in
    pieces of about ``archive_bytes``, to ``folder`` (by default below the shared folder).
    """

    prepare(pages.sparkSession)
    folder = (folder or fresh_path(pages.sparkSession, "archives")).rstrip("/")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("_payload"),
    ).withColumn("_sha1", F.unhex(F.sha1("_payload")))
    groups = (
        rows.groupBy("_sha1").agg(F.max("page_id").alias("_keep"), F.count("*").alias("_n")).where("_n > 1 and _keep is not null")
    )
    revisit = F.col("_keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keep"))
    judged = rows.join(groups, "_sha1", "left").select(
        "page_id",
        "url",
        "_sha1",
        F.length("_payload").cast("long").alias("_size"),
        F.when(revisit, F.lit(b"")).otherwise(F.col("_payload")).alias("_payload"),
        "_keep",
        revisit.alias("_revisit"),
    )
    return kept(
        judged.mapInArrow(_writer(folder, archive_bytes), "archive string, records long, bytes long"), "archive_list"
    )


def _reader(payloads: bool) -> Callable:
    fields = [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("digest_ok", pa.bool_()),
    ]
    if payloads:
        fields.append(("payload", pa.binary()))
    schema = pa.schema(fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda text: int(text) if text is not None else None
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                system, name = pa.fs.FileSystem.from_uri(path)
                with system.open_input_stream(name, compression=None) as stream:
                    out: dict[str, list] = {n: [] for n in schema.names}
                    size = 0
                    for record in read_records(iter(lambda: stream.read(READ_BYTES), b"")):
                        kind = record.headers.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        named = record.headers.get("warc-payload-digest", "").removeprefix("sha1:")
                        actual = base32_sha1(record.payload) if kind == "response" else named
                        out["page_id"].append(whole(record.headers.get(PAGE_HEADER.lower())))
                        out["url"].append(record.headers.get("warc-target-uri"))
                        out["payload_bytes"].append(
                            len(record.payload) if kind == "response" else whole(record.http.get("content-length"))
                        )
                        out["payload_digest"].append(actual)
                        out["record_type"].append(kind)
                        out["refers_to"].append(whole(record.headers.get(REFERS_HEADER.lower())))
                        out["digest_ok"].append(record.block_ok and named in ("", actual))
                        if payloads:
                            out["payload"].append(record.payload)
                        size += len(record.payload) if payloads else 200
                        if size >= BATCH_BYTES:
                            yield record_batch(out, schema)
                            out, size = {n: [] for n in schema.names}, 0
                    yield record_batch(out, schema)

    return read


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives in column ``archive``: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, digest_ok and, with ``payloads``, the payload.

    A task reads whole archives one after another. Broken framing raises; a digest that does not
    match gives ``digest_ok`` false. Paths are URIs of stores that pyarrow opens, or mounted files.
    """

    prepare(archives.sparkSession)
    n = max(1, archives.count())
    extra = ", payload binary" if payloads else ""
    return (
        archives.select("archive")
        .repartition(n)
        .mapInArrow(
            _reader(payloads),
            "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
            "refers_to long, digest_ok boolean" + extra,
        )
    )
