"""Records of a node's key-value files as columns: fixed places of a binary value, cut by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweave.functions.hashing import reversed_hex
from chainweave.registry import register
from chainweave.views import Ledger

#: Fields of a block-index record and their bytes, in order; numbers are little-endian, digests are shown reversed.
INDEX_FIELDS = (("height", 4), ("status", 4), ("n_tx", 4), ("n_file", 4), ("data_pos", 4), ("undo_pos", 4), ("version", 4), ("prev_hash", 32), ("merkle_root", 32), ("time", 4), ("bits", 4), ("nonce", 4))
INDEX_BYTES = sum(n for _, n in INDEX_FIELDS)


def _number(data: Column) -> Column:
    return F.conv(reversed_hex(F.hex(data)), 16, 10).cast("long")


def parse_block_index(data: Column) -> Column:
    """struct of INDEX_FIELDS of a block-index record; null for null and for records that end early. Bytes after the last field are ignored."""
    at, fields = 1, []
    for name, n in INDEX_FIELDS:
        part = F.substring(data, at, n)
        fields.append((F.lower(reversed_hex(F.hex(part))) if n == 32 else _number(part)).alias(name))
        at += n
    return F.when(F.octet_length(data) >= INDEX_BYTES, F.struct(*fields))


def encode_block_index(**fields: Column) -> Column:
    """The record of these fields, numbers below 2 ** 32 and digests as 64 hex digits; null if any is null."""
    parts = [fields[name] if n == 32 else F.lpad(F.hex(fields[name].cast("long")), 2 * n, "0") for name, n in INDEX_FIELDS]
    return F.unhex(F.concat(*[reversed_hex(p) for p in parts]))


def convert_key(key: Column) -> Column:
    """A key without the byte that names its kind; null for an empty key."""
    return F.when(F.octet_length(key) > 0, F.substring(key, 2, 2**31 - 1))


def key_kind(key: Column) -> Column:
    """The kind of record that a key's first byte names; null for an empty key."""
    names = {"c": "coin", "b": "block index", "B": "best block", "f": "flag", "t": "transaction index"}
    first = F.decode(F.substring(key, 1, 1), "ISO-8859-1")
    kind = F.lit("unknown")
    for letter, name in names.items():
        kind = F.when(first == letter, name).otherwise(kind)
    return F.when(F.octet_length(key) > 0, kind)


@register(
    "block_index_records",
    "SELECT 'block index' AS kind, block_hash, height, 29::BIGINT AS status, n_tx, height // 1000 AS n_file, height * 300 AS data_pos, coalesce(prev_hash, repeat('0', 64)) AS prev_hash, sha256(block_hash) AS merkle_root, ts AS time, bits FROM blocks",
)
def _records(ledger: Ledger) -> DataFrame:
    """Every block's record, written and read back, by a key of its kind and hash."""
    b = ledger["blocks"]
    zero = F.lit(0)
    data = encode_block_index(
        height=F.col("height"), status=F.lit(29), n_tx=F.col("n_tx"), n_file=F.expr("height div 1000"), data_pos=F.col("height") * 300, undo_pos=zero, version=F.lit(4),
        prev_hash=F.coalesce("prev_hash", F.lit("0" * 64)), merkle_root=F.sha2("block_hash", 256), time=F.col("ts"), bits=F.col("bits"), nonce=zero,
    )
    raw = b.select(F.concat(F.encode(F.lit("b"), "UTF-8"), F.unhex("block_hash")).alias("key"), data.alias("data"))
    read = raw.select(key_kind(F.col("key")).alias("kind"), F.lower(F.hex(convert_key(F.col("key")))).alias("block_hash"), parse_block_index(F.col("data")).alias("r"))
    return read.select("kind", "block_hash", *[f"r.{n}" for n in ("height", "status", "n_tx", "n_file", "data_pos", "prev_hash", "merkle_root", "time", "bits")])
