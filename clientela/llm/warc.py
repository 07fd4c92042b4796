"""WARC archives: writing one gzip member per record, and reading them back in sequence.

Writing goes through Spark's text writer, which takes raw bytes and reaches every file system that
Spark does. It puts a separator after each row; here that is an empty gzip member, so that a file
is a valid series of members. Readers pass over the empty ones.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shipping import ship

# Fixed value: a gzip member that holds nothing (header, empty deflate block, checksum, length).
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000030300") + bytes(8)
RECORDS_PER_FILE = 2_000
READ_STEP = 1 << 16
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadArchive(ValueError):
    """Framing, length or digest of a record is wrong."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def header_value(text: str) -> str:
    """A value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record_bytes(record_id: str, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP header alone."""
    http = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        b"Content-Length: %d\r\n\r\n" % len(payload)
    )
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{record_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", None if uri is None else header_value(uri)),
        ("WARC-Profile", None if refers_to is None else SAME_PAYLOAD),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def members(data: bytes) -> Iterator[bytes]:
    """Contents of the gzip members in order, each decompressed step by step; empty ones go."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpacker, out = zlib.decompressobj(31), []
        while not unpacker.eof:
            step = view[at : at + READ_STEP]
            if not step:
                raise BadArchive("the last member is cut off")
            try:
                out.append(unpacker.decompress(step))
            except zlib.error as error:
                raise BadArchive(f"damaged member before byte {at + len(step)}: {error}") from None
            at += len(step) - len(unpacker.unused_data)
        if content := b"".join(out):
            yield content


def read_record(content: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record, lengths and digests checked."""
    head, separator, rest = content.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not separator or not lines[0].startswith(b"WARC/"):
        raise BadArchive("not a record")
    fields = {}
    for line in lines[1:]:
        name, _, value = line.decode().partition(":")
        fields[name.strip().lower()] = value.strip()
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise BadArchive(f"{fields.get('warc-record-id')}: block is not {length} bytes long")
    if f"sha1:{sha1_base32(block)}" != fields["warc-block-digest"]:
        raise BadArchive(f"{fields.get('warc-record-id')}: block digest differs")
    return fields, block


def payload_of(fields: dict[str, str], block: bytes) -> tuple[int, str, bytes | None]:
    """Length and digest of the full payload, and the payload itself unless it is elsewhere."""
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "revisit":
        return length, digest, None
    if len(payload) != length or sha1_base32(payload) != digest:
        raise BadArchive(f"{fields.get('warc-record-id')}: payload differs from its digest")
    return length, digest, payload


def mark_revisits(
    df: DataFrame, least_bytes: int = 0, id_col: str = "page_id", text_col: str = "html"
) -> DataFrame:
    """Adds ``payload`` (binary) and ``refers_to``.

    Among payloads that are equal and at least ``least_bytes`` long, that with the largest id is
    kept in full and the others refer to it. Null text is an empty payload. Payloads count as equal
    when their SHA-256 digests are. Rows without an id are always kept in full.
    """
    payload = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    pages = df.withColumn("payload", payload).withColumn("__digest", F.sha2("payload", 256))
    kept = (
        pages.where(F.length("payload") >= least_bytes)
        .groupBy("__digest")
        .agg(F.max(id_col).alias("__kept"), F.count("*").alias("__n"))
        .where("__n > 1")
        .select("__digest", "__kept")
    )
    refers = F.when(F.col("__kept") != F.col(id_col), F.col("__kept"))
    return (
        pages.join(kept, "__digest", "left")
        .withColumn("refers_to", refers)
        .drop("__digest", "__kept")
    )


def write_warc(
    df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write rows with ``payload`` and ``refers_to`` (see ``mark_revisits``) as archives.

    A null id is written as an empty one, and read as null again.
    """
    ship(df.sparkSession)

    def batches(frames):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame(
                {
                    "value": [
                        gzip_member(record_bytes("" if i is None else i, url, bytes(p), r))
                        for i, url, p, r in frame.itertuples(index=False, name=None)
                    ]
                }
            )

    rows = df.select(
        F.col(id_col).cast("string"), F.col(url_col).alias("url"), "payload",
        F.col("refers_to").cast("string"),
    )
    (
        rows.mapInPandas(batches, "value binary")
        .select(F.col("value").cast("string").alias("value"))  # the bytes stay as they are
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives below ``path``: record_id, record_type, url, payload_bytes,
    payload_digest, refers_to, payload (null for a revisit).

    Each file is read from start to end by one task. A damaged file raises ``BadArchive``.
    """
    ship(spark)

    def batches(frames):
        import pandas as pd

        names = ["record_id", "record_type", "url", "payload_bytes", "payload_digest",
                 "refers_to", "payload"]
        for frame in frames:
            for content in frame["content"]:
                rows = []
                for member in members(content):
                    fields, block = read_record(member)
                    length, digest, payload = payload_of(fields, block)
                    refers = fields.get("warc-refers-to")
                    rows.append(
                        (fields["warc-record-id"][10:-1] or None, fields["warc-type"],
                         fields.get("warc-target-uri"), length, digest,
                         refers and refers[10:-1], payload)
                    )
                    if len(rows) == 200:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInPandas(
        batches,
        "record_id string, record_type string, url string, payload_bytes long, "
        "payload_digest string, refers_to string, payload binary",
    )
