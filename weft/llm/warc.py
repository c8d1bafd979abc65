"""WARC archives compressed by Zstandard: one frame a record, the dictionary in front."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import as_bytes, map_batches
from weft.session import ensure_checkpoint_dir, freeze

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
DATE = "2000-01-01T00:00:00Z"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Payload bytes after which a task begins its next archive.
ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 512 << 10
READ_BYTES = 1 << 20

_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_RECORDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)


def _digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(null|-?\d+)>", record_id)
    if found is None:
        raise ValueError(f"not a record id: {record_id!r}")
    return None if found[1] == "null" else int(found[1])


def encode(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record. A revisit holds the HTTP head alone, with the length of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (b"" if revisit else payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + _digest(sha1)),
        ("WARC-Block-Digest", "sha1:" + _digest(hashlib.sha1(block).digest())),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        # Everything outside printable ASCII, and the escape itself, so that reading restores it.
        fields.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~-._")))
    if revisit:
        fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", _record_id(refers_to))]
    lines = b"".join(f"{name}: {value}\r\n".encode() for name, value in fields)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def decode(record: bytes) -> tuple:
    """``page_id, url, type, refers_to, payload bytes, digest, payload`` of a valid record.

    Version, mandatory fields, the lengths of block and payload and both digests are
    checked; what does not fit is a ``ValueError``.
    """
    from urllib.parse import unquote

    head, sep, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != VERSION or not sep:
        raise ValueError(f"not a record: {record[:40]!r}")
    fields = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise ValueError(f"not a field: {line!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in fields:
            raise ValueError(f"a record without {name}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"a block of {len(rest) - 4} bytes where {length} were said")
    block = rest[:length]
    said = fields.get("warc-block-digest")
    if said is not None and said != "sha1:" + _digest(hashlib.sha1(block).digest()):
        raise ValueError("the block does not have its digest")
    http, sep, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    if not sep or size is None:
        raise ValueError("a block without HTTP head")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != int(size[1]) or digest != _digest(hashlib.sha1(payload).digest()):
            raise ValueError("the payload does not have its length or digest")
        refers_to = None
    elif kind == "revisit":
        if payload or "warc-refers-to" not in fields:
            raise ValueError("a revisit with payload or without reference")
        refers_to = _page_id(fields["warc-refers-to"])
    else:
        raise ValueError(f"a record of type {kind}")
    url = fields.get("warc-target-uri")
    return (
        _page_id(fields["warc-record-id"]), None if url is None else unquote(url), kind, refers_to,
        int(size[1]), digest, payload,
    )


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on some payloads; empty if they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archive(out, records: list[bytes]) -> int:
    """Write an archive: the dictionary in a skippable frame, then a frame a record."""
    samples, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        samples.append(r[: SAMPLE_BYTES // 8])
        size += len(samples[-1])
    learnt = dictionary(samples)
    written = 0
    if learnt:
        written += out.write(struct.pack("<II", DICTIONARY_MAGIC, len(learnt)) + learnt)
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(learnt), write_checksum=True)
    else:
        packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
    for r in records:
        written += out.write(packer.compress(r))
    return written


def read_archive(stream) -> Iterator[bytes]:
    """The records of an archive; holds one record and a piece of the file at a time."""
    data = stream.read(8)
    learnt = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", data[4:])[0]
        raw = stream.read(size)
        if len(raw) != size:
            raise ValueError("the dictionary is cut off")
        if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may be a frame itself
            raw = zstandard.ZstdDecompressor().decompress(raw)
        learnt, data = zstandard.ZstdCompressionDict(raw), b""
    unpacker = zstandard.ZstdDecompressor(dict_data=learnt) if learnt else zstandard.ZstdDecompressor()
    while data or (data := stream.read(READ_BYTES)):
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            if not data and not (data := stream.read(READ_BYTES)):
                raise ValueError("the last frame is cut off")
            parts.append(frame.decompress(data))
            data = b""
        data = frame.unused_data
        yield b"".join(parts)


def _writer(folder: str):
    def flush(records: list[bytes]) -> tuple[str, int, int]:
        # A name of its own for every attempt; only what the manifest lists counts.
        where, root = fs.FileSystem.from_uri(folder)
        name = f"{uuid.uuid4().hex}.warc.zst"
        with where.open_output_stream(f"{root}/{name}") as out:
            size = write_archive(out, records)
        return f"{folder}/{name}", len(records), size

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size, made = [], 0, []
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("page_id", "url", "sha1", "refers_to", "revisit")]
            for payload, (page_id, url, sha1, refers_to, revisit) in zip(as_bytes(batch["html"]), zip(*columns)):
                records.append(encode(page_id, url, payload, bytes.fromhex(sha1), refers_to, revisit))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    made.append(flush(records))
                    records, size = [], 0
        if records:
            made.append(flush(records))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), _MANIFEST)], schema=_MANIFEST)

    return write


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` as archives into ``folder``, which all executors share; the manifest.

    Of pages with equal payloads of ``min_bytes`` or more, the one with the smallest id is a
    response and the others are revisits of it. Rows repeated with that id are responses as
    well; without any id, all are responses. A null html is an empty payload, a null id or
    url is kept as null, and an empty table gives an empty manifest ``path, records, bytes``.
    Other columns are not read. The payload itself is shuffled once, to its equals; a
    payload of many pages is split by adaptive execution, as the join allows.
    """
    rows = pages.select(
        F.col(id).cast("bigint").alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("html"),
    ).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    first = (
        rows.filter(F.octet_length("html") >= min_bytes)
        .groupBy("sha1").agg(F.min("page_id").alias("refers_to"))
    )
    typed = (
        rows.join(first, "sha1", "left")
        .withColumn("revisit", F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select("page_id", "url", "html", "sha1", F.when(F.col("revisit"), F.col("refers_to")).alias("refers_to"), "revisit")
    )
    fs_, root = fs.FileSystem.from_uri(folder)
    fs_.create_dir(root, recursive=True)
    return freeze(map_batches(typed, _writer(folder), "path string, records long, bytes long"))


def _reader(keep_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                where, name = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with where.open_input_stream(name) as stream:
                    for raw in read_archive(stream):
                        *head, payload = decode(raw)
                        rows.append((*head, payload if keep_payload else None))
                        size += len(payload) if keep_payload else 0
                        if len(rows) >= 1000 or size >= 8 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORDS)], schema=_RECORDS)

    return read


def read_warc(archives: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the archives in column ``path``.

    ``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload``; the
    payload is empty for revisits, and null for all with ``payload=False``. Every record is
    checked as ``decode`` says. Archives are dealt out one by one, whatever files list them.
    """
    number = max(1, archives.count())
    spread = archives.select("path").repartition(number, "path") if number > 1 else archives.select("path")
    return map_batches(
        spread, _reader(payload),
        "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary",
    )


def archives_below(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` of every archive in a folder, listed by Spark without reading the files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path")


def new_folder(spark: SparkSession) -> str:
    """A folder for archives below the shared checkpoint folder, as a URI."""
    base = ensure_checkpoint_dir(spark)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + base
    elif base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base.removeprefix("file:")
    return f"{base}/warc-{uuid.uuid4().hex}"
