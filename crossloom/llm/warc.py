"""WARC archives with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Spark writes and reads the archives itself, so they go to any file system it
knows and a lost task leaves nothing behind. Its text sink ends every archive
with a line separator; the separator used here is an empty skippable frame,
which readers of the format pass over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossloom.llm.common import shared_folder
from crossloom.operators.ordering import fits_broadcast
from crossloom.session import materialize

# Fixed values of the formats.
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
EMPTY_FRAME = b"\x50\x2a\x4d\x18\x00\x00\x00\x00"
ZSTD_DICTIONARY = b"\x37\xa4\x30\xec"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of their own
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

MIN_PAYLOAD = 100  # bytes from which equal payloads are stored once
ARCHIVE_BYTES = 32 << 20  # of compressed records in one archive
SAMPLE_RECORDS = 400  # first records of an archive that its dictionary is trained on
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 1 << 14


class ArchiveError(ValueError):
    """A malformed archive or record."""


def record(page_id, url, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One record in plain form. A revisit keeps the HTTP header, so the payload's length stays known."""
    import re

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    safe = re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {safe}"] if safe else []), *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if revisit else []),
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The records as one archive; without enough of them to train on it has no dictionary."""
    import zstandard as zstd

    sample, size = [], 0
    for r in records[:SAMPLE_RECORDS]:
        size += len(r)
        if size > SAMPLE_BYTES:
            break
        sample.append(r)
    held = None
    if len(sample) >= 16 and size > 8 * DICTIONARY_BYTES:
        try:
            held = zstd.train_dictionary(DICTIONARY_BYTES, sample)
        except zstd.ZstdError:
            held = None  # samples that have nothing in common
    out = []
    if held is not None:
        content = held.as_bytes()
        out = [DICTIONARY_MAGIC, len(content).to_bytes(4, "little"), content]
    packer = zstd.ZstdCompressor(level=3, dict_data=held, write_checksum=True, write_content_size=True)
    return b"".join([*out, *(packer.compress(r) for r in records)])


def frame_end(buf: bytes, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends, from its block headers."""
    import zstandard as zstd

    if buf[at : at + 4] != FRAME_MAGIC:
        raise ArchiveError(f"no frame at byte {at}")
    try:
        head = buf[at : at + 18]
        end, tail = at + zstd.frame_header_size(head), 4 * zstd.get_frame_parameters(head).has_checksum
    except zstd.ZstdError as e:
        raise ArchiveError(f"bad frame header at byte {at}") from e
    last = False
    while not last:
        block = int.from_bytes(buf[end : end + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        end += 3 + (1 if kind == 1 else size)
        if kind == 3 or end + tail > len(buf):
            raise ArchiveError(f"the frame at byte {at} is cut off or broken")
    return end + tail


def read_archive(buf: bytes):
    """(headers, block) of every record, in order; a defect raises ArchiveError."""
    import zstandard as zstd

    at, held = 0, None
    if buf[:4] == DICTIONARY_MAGIC:
        at = 8 + int.from_bytes(buf[4:8], "little")
        content = buf[8:at]
        if at > len(buf):
            raise ArchiveError("the dictionary is cut off")
        if content[:4] == FRAME_MAGIC:  # the dictionary itself may be compressed
            content = zstd.ZstdDecompressor().decompressobj().decompress(content)
        if content[:4] != ZSTD_DICTIONARY:
            raise ArchiveError("the leading skippable frame holds no dictionary")
        held = zstd.ZstdCompressionDict(content)
    unpack = zstd.ZstdDecompressor(dict_data=held)
    while at < len(buf):
        if 0x50 <= buf[at] <= 0x5F and buf[at + 1 : at + 4] == b"\x2a\x4d\x18":
            at += 8 + int.from_bytes(buf[at + 4 : at + 8], "little")
            continue
        end = frame_end(buf, at)
        try:
            plain = unpack.decompressobj().decompress(buf[at:end])
        except zstd.ZstdError as e:
            raise ArchiveError(f"the frame at byte {at} does not decode") from e
        yield parse(plain)
        at = end
    if at > len(buf):
        raise ArchiveError("a skippable frame is cut off")


def parse(plain: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, found, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError("no record header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ArchiveError(f"bad header line {line[:60]!r}")
        headers[name.strip()] = value.strip()
    missing = [h for h in REQUIRED if h not in headers]
    if missing or not headers["Content-Length"].isdigit():
        raise ArchiveError(f"missing or bad: {missing or 'Content-Length'}")
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ArchiveError(f"a block of {size} bytes is announced, {len(rest) - 4} are there")
    return headers, rest[:size]


def _page(urn: str | None) -> int | None:
    inner = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner.lstrip("-").isdigit() else None


def entry(headers: dict[str, str], block: bytes) -> tuple:
    """Row of a record: (page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload)."""
    import hashlib
    import re

    kind, digest = headers["WARC-Type"], headers.get("WARC-Payload-Digest", "").removeprefix("sha256:")
    if kind not in ("response", "revisit"):
        raise ArchiveError(f"record type {kind}")
    http, found, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"\r\nContent-Length: *(\d+)", http)
    if not found or not size:
        raise ArchiveError("no HTTP header in the block")
    if kind == "response":
        if len(payload) != int(size[1]) or hashlib.sha256(payload).hexdigest() != digest:
            raise ArchiveError("the payload does not match its length or digest")
    elif payload or "WARC-Refers-To" not in headers:
        raise ArchiveError("a revisit with a payload or without a target")
    return (_page(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), kind, _page(headers.get("WARC-Refers-To")), int(size[1]), digest,
            payload if kind == "response" else None)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = MIN_PAYLOAD,
          archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per row to archives below ``path``.

    Equal payloads of at least ``min_payload`` bytes are stored with the
    smallest id only; the other records revisit it. NULL html is an empty
    payload, a NULL url gives no target, rows of the smallest id that are
    repeated are all stored, and among rows without an id nothing is a revisit
    of them. Payloads stay in their partition unless the table of repeated
    digests is too large to be sent around.
    """
    raw = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), raw.alias("raw"))
    rows = rows.withColumn("digest", F.sha2("raw", 256))
    twice = rows.filter(F.length("raw") >= min_payload).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    twice = materialize(twice.filter((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first"))
    joined = rows.join(F.broadcast(twice) if fits_broadcast(twice) else twice, "digest", "left")

    def task(batches):
        import pyarrow as pa

        held, size = [], 0
        for b in batches:
            for i in range(b.num_rows):
                page, url, payload, digest, first = (b.column(j)[i].as_py() for j in range(5))
                again = first is not None and first != page
                held.append(record(page, url, payload, digest, first, again))
                size += len(held[-1])
                if size >= 3 * archive_bytes:  # HTML shrinks to about a third
                    yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], ["value"])

    files = joined.select("id", "url", "raw", "digest", "first").mapInArrow(task, "value binary").select(F.col("value").cast("string"))
    files.write.option("lineSep", EMPTY_FRAME.decode("ascii")).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType()),
])


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``, all checked; revisits have a NULL payload."""
    schema = SCHEMA if with_payload else T.StructType(SCHEMA.fields[:-1])

    def task(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], arrow.names)

        for b in batches:
            for i in range(b.num_rows):
                rows, size = [], 0
                for headers, block in read_archive(b.column(0)[i].as_py()):
                    rows.append(entry(headers, block)[: len(arrow)])
                    size += len(block) if with_payload else 0
                    if len(rows) >= 4096 or size > 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(task, schema)


def query(spark, sf_dir):
    path = shared_folder(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
q AS (SELECT page_id, octet_length(raw)::BIGINT AS payload_bytes, sha256(raw) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 100) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
FROM r
"""
