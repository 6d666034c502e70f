"""A multiplicative set hash modulo a 3072-bit prime: order doesn't matter, and rows can be taken out again."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIME = (1 << 3072) - 1103717


def _keystream(key: bytes, size: int) -> bytes:
    """ChaCha20 keystream, nonce and counter from 0."""
    mask, out = 0xFFFFFFFF, b""
    for counter in range(-(-size // 64)):
        start = [*struct.unpack("<4I", b"expand 32-byte k"), *struct.unpack("<8I", key), counter, 0, 0, 0]
        x = list(start)

        def quarter(a: int, b: int, c: int, d: int) -> None:
            for p, q, r, n in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
                x[p] = (x[p] + x[q]) & mask
                v = x[r] ^ x[p]
                x[r] = ((v << n) | (v >> (32 - n))) & mask

        for _ in range(10):
            for i in range(4):
                quarter(i, 4 + i, 8 + i, 12 + i)
            for i in range(4):
                quarter(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4)
        out += struct.pack("<16I", *((a + b) & mask for a, b in zip(x, start, strict=True)))
    return out[:size]


def element(data: bytes) -> int:
    """The number that stands for a row."""
    return int.from_bytes(_keystream(hashlib.sha256(data).digest(), 384), "little") % PRIME


def digest(product: int) -> str:
    return hashlib.sha256(product.to_bytes(384, "little")).hexdigest()


def combine(added: int, removed: int = 1) -> int:
    return added * pow(removed, -1, PRIME) % PRIME


def product(rows: DataFrame, column: str) -> int:
    """Product over a binary column: a number for each task, then one for all. What reaches the driver are 384 bytes a task."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = 1
        for b in batches:
            for v in b.column(0).to_pylist():
                p = p * element(v) % PRIME
        yield pa.RecordBatch.from_arrays([pa.array([p.to_bytes(384, "little")], pa.binary())], names=["p"])

    out = 1
    for r in rows.select(F.col(column)).mapInArrow(part, "p binary").toLocalIterator():
        out = out * int.from_bytes(r["p"], "little") % PRIME
    return out
