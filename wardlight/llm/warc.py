"""Content-addressed WARC archive.

Two tables: `payloads` keeps every distinct payload once under its SHA-256,
`headers` keeps the exact header block of every record and the digest it refers
to. A join on the digest gives the original records back, byte by byte.

Payloads are zstd frames from the first step on, so each later shuffle and
both tables move compressed bytes. Equal digests are verified: every record
also carries a second, independent digest (BLAKE2b) of its payload, and writing
fails if one SHA-256 ever covers two of them. Reading recomputes the SHA-256 of
what it unpacks and fails on a mismatch.

Null and empty payloads are the empty byte string; null URLs give an empty
target. Every row is a record of its own, whose id is made of the page's id and a number of the row, so rows
that repeat a page id, with the same payload or another one, stay apart. Of equal payloads the records with
the least page id are responses, all of them where rows repeat it; a null page id comes last. Payloads
below `min_revisit_bytes` are always `response` records. Without pages both tables are empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm.common import released, stored

MIN_REVISIT_BYTES = 100
_CRLF = "\r\n"
_SEALED = "page_id long, row long, target string, digest string, check binary, payload_bytes long, packed binary"


def _seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests and packed payload of each page."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        bodies = [body or b"" for body in batch.column("body").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"),
                batch.column("row"),
                batch.column("target"),
                pa.array([hashlib.sha256(body).hexdigest() for body in bodies], pa.string()),
                pa.array([hashlib.blake2b(body, digest_size=16).digest() for body in bodies], pa.binary()),
                pa.array([len(body) for body in bodies], pa.int64()),
                pa.array([pack.compress(body) for body in bodies], pa.binary()),
            ],
            names=["page_id", "row", "target", "digest", "check", "payload_bytes", "packed"],
        )


def _unseal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Original record bytes: header block, then the payload where the record holds it."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        digests = batch.column("digest").to_pylist()
        payloads = [unpack.decompress(packed) for packed in batch.column("packed").to_pylist()]
        for digest, payload in zip(digests, payloads, strict=True):
            if hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"stored payload does not match its digest {digest}")
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("header"), pa.array(payloads, pa.binary())],
            names=["page_id", "header", "payload"],
        )


def _urn(page_id: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id, F.lit(":"), row.cast("string"), F.lit(">"))


def _header(record_type: Column, refers_to: Column) -> Column:
    """The header block of a record, up to and with its blank line; `refers_to` is a record's id or null."""
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), record_type),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.col("row"))),
        F.concat(F.lit("WARC-Target-URI: "), F.col("target")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("WARC-Refers-To: "), refers_to),
        F.when(refers_to.isNotNull(), F.lit("WARC-Profile: identical-payload-digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.concat(
            F.lit("Content-Length: "),
            F.when(refers_to.isNull(), F.col("payload_bytes")).otherwise(F.lit(0)).cast("string"),
        ),
    ]
    return F.concat(F.concat_ws(_CRLF, *lines), F.lit(_CRLF + _CRLF))


def write_archive(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Writes pages (page_id, url, html) as `folder`/payloads and `folder`/headers.

    Line breaks in a URL would end a header line, so they are percent-encoded.
    A payload that a third of all pages share is reduced to one row per task
    before the shuffle; only the small header rows meet their digest's first
    page, in a join whose skewed partitions Spark splits.
    """
    target = F.coalesce(F.col("url").cast("string"), F.lit(""))
    target = F.replace(F.replace(target, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    numbered = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.monotonically_increasing_id().alias("row"),
        target.alias("target"),
        F.encode(F.col("html").cast("string"), "UTF-8").alias("body"),
    )
    # Compressed once; the headers do not read the packed payloads.
    sealed = stored(numbered.mapInArrow(_seal, _SEALED), "warc-sealed")

    one_payload = F.assert_true(
        F.col("least_check") == F.col("most_check"), F.lit("one SHA-256 covers two payloads")
    )
    sealed.groupBy("digest").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "row")).alias("first"),
        F.min("check").alias("least_check"),
        F.max("check").alias("most_check"),
        F.first("payload_bytes").alias("payload_bytes"),
        F.first("packed").alias("packed"),
    ).select(
        "digest",
        "first",
        "payload_bytes",
        F.when(one_payload.isNull(), F.col("packed")).alias("packed"),
    ).write.option("compression", "uncompressed").parquet(f"{folder}/payloads")

    firsts = pages.sparkSession.read.parquet(f"{folder}/payloads").select("digest", "first")
    revisit = (F.col("payload_bytes") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    refers_to = F.when(revisit, _urn(F.coalesce(F.col("first.page_id").cast("string"), F.lit("none")), F.col("first.row")))
    record_type = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    sealed.select("page_id", "row", "target", "digest", "payload_bytes").join(firsts, "digest").select(
        "page_id", "digest", _header(record_type, refers_to).alias("header")
    ).write.option("compression", "zstd").parquet(f"{folder}/headers")
    released(sealed)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The records (page_id, header, payload), each payload joined from the store and verified.

    A revisit's payload is the one it refers to; its own record ends with the
    header block (see `record_bytes`).
    """
    headers = spark.read.parquet(f"{folder}/headers")
    payloads = spark.read.parquet(f"{folder}/payloads").select("digest", "packed")
    return headers.join(payloads, "digest").mapInArrow(
        _unseal, "page_id long, header string, payload binary"
    )


def header_field(name: str) -> Column:
    """The value of one header line, null where the record has no such line."""
    found = F.regexp_extract(F.col("header"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.contains(F.col("header"), F.lit(f"\r\n{name}: ")), found)


def page_of(urn: Column) -> Column:
    """The page of a record's id, null for a page without one."""
    return F.nullif(F.regexp_extract(urn, "<urn:page:(-?[0-9]*)", 1), F.lit("")).cast("long")


def record_bytes(records: DataFrame) -> DataFrame:
    """Each record as it stands in a WARC file: header, content, two line ends."""
    holds = header_field("WARC-Type") == "response"
    content = F.when(holds, F.col("payload")).otherwise(F.lit(b""))
    return records.select(
        "page_id",
        F.concat(F.encode("header", "UTF-8"), content, F.lit(b"\r\n\r\n")).alias("record"),
    )


def page_records(records: DataFrame) -> DataFrame:
    """What the archive says of each page."""
    refers_to = header_field("WARC-Refers-To")
    return records.select(
        page_of(header_field("WARC-Record-ID")).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        header_field("WARC-Type").alias("record_type"),
        F.when(refers_to.isNotNull(), page_of(refers_to)).alias("refers_to"),
    )
