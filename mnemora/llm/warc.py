"""WARC archives in Zstandard: one frame a record, with the dictionary in a leading skippable frame.

The writer makes one archive of each bounded run of records and keeps the archives as rows of a table, so that
Spark's own writers store them on any file system. The reader takes such a table, or archive files by
`spark.read.format("binaryFile")` (column `content`, so up to 2 GB an archive). It loads the dictionary of each archive,
decodes one frame per record, in time in proportion to the archive, and validates frames, headers, lengths and digests:
a record that fails raises with its archive and place. Header names count in any case, as the format has it.

Of records with equal payloads of at least a given size, that with the largest id is the response and the others
revisit it. Rows that repeat the largest id are all responses.

Defined cases: a null payload is empty; a null id is written as the empty id and is smaller than any other; a null
URL is the empty URL; an empty table gives no archive; further columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialise, text_of

#: Fixed values of the formats: frame magics, the skippable frame of a dictionary, and the revisit profile.
ZSTD_MAGIC, DICT_FRAME_MAGIC, DICT_MAGIC = 0xFD2FB528, 0x184D2A5D, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed date of the records, as the tables have none.
DATE = "2024-01-01T00:00:00Z"
#: An archive is closed at so many records or bytes of payload.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 2_000, 16_000_000
#: The dictionary of an archive is trained on so many of its first records, up to so many characters of each.
DICT_RECORDS, DICT_SAMPLE, DICT_BYTES = 256, 4_096, 16_384
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: Headers that may stand more than once in a record (a fixed value of the format).
MAY_REPEAT = ("warc-concurrent-to",)
#: Bytes that the decoder is given at once.
SLICE = 1 << 16


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: str, url: str, payload: bytes, kind: str, refers_to: str) -> bytes:
    """One WARC record; a revisit has no payload of its own."""
    body = payload if kind == "response" else b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + body
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head[6:6] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Truncated-Payload-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained_dictionary(records: list[bytes]) -> bytes:
    """A Zstandard dictionary of the first records, empty if they are too few or too much alike to train one."""
    samples = [r[:DICT_SAMPLE] for r in records[:DICT_RECORDS]]
    if len(samples) < 16 or sum(map(len, samples)) < 4 * DICT_BYTES:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive_bytes(records: list[bytes]) -> bytes:
    own = trained_dictionary(records)
    packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(own) if own else None, write_checksum=True, write_content_size=True)
    lead = b""
    if own:
        packed = zstandard.ZstdCompressor(level=9).compress(own)
        lead = struct.pack("<II", DICT_FRAME_MAGIC, len(packed)) + packed
    return lead + b"".join(packer.compress(r) for r in records)


def read_dictionary(data: bytes) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of an archive and the place of its first record; the frame may hold it packed or plain."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICT_FRAME_MAGIC:
        return None, 0
    (size,) = struct.unpack_from("<I", data, 4)
    body = data[8 : 8 + size]
    if len(body) < size or size < 4:
        raise ValueError("the dictionary frame is cut off")
    (magic,) = struct.unpack_from("<I", body)
    if magic == ZSTD_MAGIC:
        body = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 27)
    elif magic != DICT_MAGIC:
        raise ValueError("the dictionary frame holds no dictionary")
    return zstandard.ZstdCompressionDict(body), 8 + size


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (their names in lower case, values of repeated ones parted by line feeds) and block of a record, validated."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        known = name.lower()
        if not colon or not name or name != name.strip() or known in headers and known not in MAY_REPEAT:
            raise ValueError(f"bad header line: {line[:80]!r}")
        headers[known] = f"{headers[known]}\n{value.strip()}" if known in headers else value.strip()
    if missing := [h for h in REQUIRED if h not in headers]:
        raise ValueError(f"headers missing: {missing}")
    size = headers["content-length"]
    if not (size.isascii() and size.isdigit()) or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not fit the record")
    block = rest[:-4]
    if (digest := headers.get("warc-block-digest")) and digest.startswith("sha1:") and digest != f"sha1:{sha1_base32(block)}":
        raise ValueError("the block's digest differs")
    return headers, block


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive: one frame each."""
    own, at = read_dictionary(data)
    unpacker, n = zstandard.ZstdDecompressor(dict_data=own) if own else zstandard.ZstdDecompressor(), 0
    view = memoryview(data)
    while at < len(data):
        if len(data) - at < 4 or struct.unpack_from("<I", data, at)[0] != ZSTD_MAGIC:
            raise ValueError(f"record {n}: no frame at byte {at}")
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            if at == len(data):
                raise ValueError(f"record {n}: the frame is cut off")
            parts.append(frame.decompress(view[at : at + SLICE]))
            at = min(at + SLICE, len(data))
        at -= len(frame.unused_data)  # of the last slice only
        try:
            yield parse_record(b"".join(parts))
        except ValueError as e:
            raise ValueError(f"record {n}: {e}") from e
        n += 1


def with_heads(pages: DataFrame, payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """`page_id`, `url`, `payload` and `refers_to`: the largest id among equal payloads if that is another row's.

    Only digests that occur twice or more are joined back, one row a digest. A digest of very many pages, as that of the
    empty payload, is taken to the pages as they lie, so copies do not meet in one task.
    """
    rows = pages.select(F.col("page_id"), text_of("url").alias("url"), F.encode(text_of(f"`{payload}`"), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    heads = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("head")).filter("n > 1")
    return join_hot(rows, materialise(heads), "digest", "n").select("page_id", "url", "payload", F.when(F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")).alias("refers_to"))


def write_archives(pages: DataFrame, payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Archives of `pages`, one row each: `records` and `data`; written once to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        size = 0
        for batch in batches:
            for page_id, url, body, head in zip(*(c.to_pylist() for c in batch.columns)):
                kind = "response" if head is None else "revisit"
                records.append(record_bytes("" if page_id is None else str(page_id), url, body, kind, str(head)))
                size += len(body)
                if len(records) >= ARCHIVE_RECORDS or size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_pydict({"records": pa.array([len(records)], pa.int64()), "data": pa.array([archive_bytes(records)], pa.binary())})
                    records, size = [], 0
        if records:
            yield pa.RecordBatch.from_pydict({"records": pa.array([len(records)], pa.int64()), "data": pa.array([archive_bytes(records)], pa.binary())})

    return materialise(with_heads(pages, payload, min_bytes).mapInArrow(run, "records long, data binary"))


def read_archives(archives: DataFrame, column: str = "data") -> DataFrame:
    """One row a record: `record_id`, `url`, `record_type`, `refers_to`, `payload_bytes`, `payload_digest`, `payload`.

    Records but responses have no payload; length and digest of a revisit are those that its headers state for the payload
    it refers to, null where they state none.
    """
    names = ["record_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]

    def row(headers: dict[str, str], block: bytes):
        _, _, payload = block.partition(b"\r\n\r\n")
        kind = headers["warc-type"]
        digest = headers.get("warc-payload-digest", "")
        if kind == "response":
            own = sha1_base32(payload)
            if digest.startswith("sha1:") and digest != f"sha1:{own}":
                raise ValueError(f"{headers['warc-record-id']}: the payload's digest differs")
            digest, size = own, len(payload)
        else:
            stated = headers.get("warc-truncated-payload-length")
            digest, size, payload = digest.removeprefix("sha1:") or None, stated and int(stated), None
        refers = headers.get("warc-refers-to")
        bare = lambda x: x.removeprefix("<urn:page:").removesuffix(">")
        return bare(headers["warc-record-id"]), headers.get("warc-target-uri"), kind, refers and bare(refers), size, digest, payload

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for headers, block in read_archive(data.as_py()):
                    rows.append(row(headers, block))
                    if len(rows) >= 256:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    return archives.select(column).mapInArrow(run, "record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write every page to archives, read them back: a row per page, without payloads."""
    back = read_archives(write_archives(pages))
    kind = pages.schema["page_id"].dataType
    number = lambda c: F.expr(f"try_cast({c} AS {kind.simpleString()})").alias(c)
    return back.withColumnRenamed("record_id", "page_id").select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"), "url")
