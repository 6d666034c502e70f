"""A content-addressed web archive.

Payload bytes are stored once, under their SHA-256 digest and length; record headers are stored apart, exactly as a WARC file has them, one row for each
record, with the address of the payload. The first record of a payload, that of the smallest id, is a response; the others revisit it.
Reading verifies every payload against its address, and each record's digest and length against its payload, and gives records back by a join.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainweave.llm.common import new_path, stored

#: Payloads of so many bytes or more are revisited rather than repeated.
MIN_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 digest: its 160 bits are four numbers of 40 bits, eight base-32 digits each."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def _address(payload: Column) -> list[Column]:
    return [F.sha2(payload, 256).alias("address"), F.octet_length(payload).cast("long").alias("bytes")]


def record_id(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))


def header(key: Column, url: Column, kind: Column, digest: Column, size: Column, refers_to: Column, date: str = DATE) -> Column:
    """Header of a record, from its version line to the empty line that ends it."""
    safe = F.regexp_replace(F.regexp_replace(url.cast("string"), "\r", "%0D"), "\n", "%0A")
    revisit = kind == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return F.concat_ws(
        "",
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", record_id(key)),
        F.lit(f"WARC-Date: {date}\r\n"),
        line("WARC-Target-URI", safe),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}\r\n")),
        F.when(revisit, line("WARC-Refers-To", record_id(refers_to))),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(size.cast("string"))),
        F.lit("\r\n"),
    )


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES) -> str:
    """Writes tables `payloads` (address, bytes, payload) and `records` (header, address, bytes) under path; returns path.

    Payloads are texts in UTF-8, or binaries; null is empty. Of records with equal payloads of at least min_bytes bytes, that with the smallest key is the response, and so are rows
    that repeat its key; a null key is never smallest, unless all are null, and then all are responses. Null URLs have no header line, and line ends in
    URLs are percent-encoded. An empty table gives an empty archive. Other columns are not stored.
    """
    body = F.coalesce(pages[f"`{payload}`"].cast("binary"), F.lit(b""))
    rows = pages.select(pages[f"`{key}`"].alias("key"), pages[f"`{url}`"].alias("url"), body.alias("payload"))
    heads = stored(rows.select("key", "url", *_address(F.col("payload")), base32_sha1(F.col("payload")).alias("digest"), F.xxhash64("payload").alias("mark")), "warc-heads")
    first = stored(heads.groupBy("address", "bytes").agg(F.min("key").alias("first"), F.max("digest").alias("digest"), F.max("mark").alias("mark")), "warc-first")
    kind = F.when((F.col("bytes") < min_bytes) | F.col("key").eqNullSafe(F.col("first")), F.lit("response")).otherwise(F.lit("revisit"))
    typed = heads.drop("digest", "mark").join(first, ["address", "bytes"]).withColumn("kind", kind)
    typed = typed.select(header(F.col("key"), F.col("url"), F.col("kind"), F.col("digest"), F.col("bytes"), F.col("first")).alias("header"), "address", "bytes")
    typed.write.option("compression", "zstd").parquet(f"{path}/records")
    # Payloads go to the archive from the first record of each, found by its key; thin rows decide, so that no other payload is moved twice.
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    mine = first.select(name("first").alias("name"), "mark")
    held = rows.select(name("key").alias("name"), F.xxhash64("payload").alias("mark"), "payload")
    # Rows that repeat a record stand together after the join already.
    unique = held.join(mine, ["name", "mark"], "left_semi").dropDuplicates(["name", "mark"])
    unique = unique.select(*_address(F.col("payload")), "payload")
    unique.write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def _field(name: str, pattern: str) -> Column:
    return F.regexp_extract("header", rf"\r\n{name}: {pattern}\r\n", 1)


def _id(name: str) -> Column:
    return F.expr(f"try_cast(nullif(regexp_extract(header, '\\\\r\\\\n{name}: <urn:page:([^>]*)>', 1), '') AS BIGINT)")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(key, url, record_type, refers_to, payload_digest, payload_bytes, header, payload) of every record, payloads in full for revisits too.

    Fails on a payload whose digest or length isn't its address, and on a record whose digest isn't its payload's.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    good = (F.sha2("payload", 256) == F.col("address")) & (F.octet_length("payload") == F.col("bytes"))
    checked = payloads.select("address", F.when(good, F.octet_length("payload").cast("long")).otherwise(F.raise_error(F.lit("a payload is not what its address says"))).alias("payload_bytes"), base32_sha1(F.col("payload")).alias("actual"), "payload")
    records = spark.read.parquet(f"{path}/records").select(
        _id("WARC-Record-ID").alias("key"),
        F.expr("nullif(regexp_extract(header, '\\\\r\\\\nWARC-Target-URI: ([^\\\\r]*)', 1), '')").alias("url"),
        _field("WARC-Type", "(\\w+)").alias("record_type"),
        _id("WARC-Refers-To").alias("refers_to"),
        _field("WARC-Payload-Digest", "sha1:([A-Z2-7]{32})").alias("digest"),
        "address",
        "header",
    )
    same = F.when(F.col("digest") == F.col("actual"), F.col("digest")).otherwise(F.raise_error(F.lit("a record's digest is not its payload's")))
    joined = records.join(checked, "address", "left")
    return joined.select("key", "url", "record_type", "refers_to", same.alias("payload_digest"), "payload_bytes", "header", "payload")


def warc_bytes(archive: DataFrame) -> DataFrame:
    """(key, record): records as a WARC file has them, header, block and two line ends; a revisit's block is empty."""
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return archive.select("key", F.concat(F.col("header").cast("binary"), block, F.lit(b"\r\n\r\n")).alias("record"))


def parse_warc(files: DataFrame, content: str = "content") -> DataFrame:
    """(header, block) of every record of WARC files, plain or gzipped, given as binaries (as the binaryFile source reads them). Null files have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("content"):
                data = value.as_py() or b""
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                heads, blocks, at = [], [], 0
                while (end := data.find(b"\r\n\r\n", at)) >= 0 and data[at : at + 5] == b"WARC/":
                    head = data[at : end + 4]
                    size = next((int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
                    heads.append(head.decode("utf-8", "replace"))
                    blocks.append(data[end + 4 : end + 4 + size])
                    at = end + 4 + size + 4
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.string()), pa.array(blocks, pa.binary())], names=["header", "block"])

    return files.select(F.col(content).alias("content")).mapInArrow(run, "header string, block binary")


def archived(pages: DataFrame, **options) -> DataFrame:
    """What read_archive gives of an archive of pages, written to the shared folder."""
    spark = pages.sparkSession
    return read_archive(spark, write_archive(pages, new_path(spark, "warc"), **options))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, list_aggregate(list_transform(range(32), lambda i:
    substr('{_BASE32}', (((('0x' || substr(h, (1 + 10 * (i // 8))::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31) + 1)::INT, 1)), 'string_agg', '') AS d,
  min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM b
"""
