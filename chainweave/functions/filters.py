"""Compact block filters: Golomb-coded sets of the scripts that a block pays and spends, as BIP 158 specifies them."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.functions.wire import Reader, compact_size

#: Bits of a remainder, and the inverse of the rate of false matches; fixed values of the basic filter.
REMAINDER_BITS, INVERSE_RATE = 19, 784931

_SIP = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)


def _roll(v: np.ndarray, n: int) -> np.ndarray:
    return v << np.uint64(n) | v >> np.uint64(64 - n)


def _rounds(v: list[np.ndarray], n: int) -> None:
    for _ in range(n):
        v[0] = v[0] + v[1]
        v[1] = _roll(v[1], 13) ^ v[0]
        v[0] = _roll(v[0], 32)
        v[2] = v[2] + v[3]
        v[3] = _roll(v[3], 16) ^ v[2]
        v[0] = v[0] + v[3]
        v[3] = _roll(v[3], 21) ^ v[0]
        v[2] = v[2] + v[1]
        v[1] = _roll(v[1], 17) ^ v[2]
        v[2] = _roll(v[2], 32)


def siphash_many(k0: np.ndarray, k1: np.ndarray, data: list[bytes]) -> np.ndarray:
    """SipHash-2-4 of each item under its own key; items of one length are hashed together."""
    out, by_length = np.zeros(len(data), np.uint64), {}
    for i, d in enumerate(data):
        by_length.setdefault(len(d), []).append(i)
    for n, places in by_length.items():
        at = np.array(places)
        padded = b"".join(data[i] + b"\0" * (7 - n % 8) + bytes([n & 255]) for i in places)
        words = np.frombuffer(padded, "<u8").reshape(len(places), -1)
        v = [(k0 if i % 2 == 0 else k1)[at] ^ np.uint64(s) for i, s in enumerate(_SIP)]
        for m in words.T:
            v[3] = v[3] ^ m
            _rounds(v, 2)
            v[0] = v[0] ^ m
        v[2] = v[2] ^ np.uint64(0xFF)
        _rounds(v, 4)
        out[at] = v[0] ^ v[1] ^ v[2] ^ v[3]
    return out


def _key(block_hash: str) -> tuple[int, int]:
    return struct.unpack("<2Q", bytes.fromhex(block_hash)[::-1][:16])


def _places(block_hash: str, items: list[bytes], n: int) -> list[int]:
    """Items as numbers below n * INVERSE_RATE."""
    k0, k1 = (np.full(len(items), k, np.uint64) for k in _key(block_hash))
    return [int(h) * n * INVERSE_RATE >> 64 for h in siphash_many(k0, k1, items)]


def encode_filter(block_hash: str, scripts: list[bytes]) -> bytes:
    """The filter of a block's distinct non-empty scripts; block_hash in display order."""
    items = sorted({s for s in scripts if s})
    at, bits = 0, []
    for place in sorted(_places(block_hash, items, len(items))):
        bits.append("1" * (place - at >> REMAINDER_BITS) + "0" + format(place - at & (1 << REMAINDER_BITS) - 1, f"0{REMAINDER_BITS}b"))
        at = place
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return compact_size(len(items)) + (int(text, 2).to_bytes(len(text) // 8, "big") if text else b"")


def decode_filter(data: bytes) -> tuple[int, list[int]]:
    """(number of items, their places in order) of a filter. Raises ValueError if the data ends early."""
    r = Reader(data)
    n = r.size()
    rest = data[r.at :]
    text = format(int.from_bytes(rest, "big"), f"0{8 * len(rest)}b") if rest else ""
    at, place, out = 0, 0, []
    for _ in range(n):
        stop = text.find("0", at)
        end = stop + 1 + REMAINDER_BITS
        if stop < 0 or end > len(text):
            raise ValueError("the filter ends early")
        place += (stop - at << REMAINDER_BITS) + int(text[stop + 1 : end], 2)
        out.append(place)
        at = end
    return n, out


def matches(block_hash: str, data: bytes, scripts: list[bytes]) -> bool:
    """Whether a filter holds any of these scripts; never wrongly no, wrongly yes for one script in INVERSE_RATE."""
    n, places = decode_filter(data)
    return bool(n and scripts and set(places) & set(_places(block_hash, scripts, n)))


def filter_header(data: bytes, previous: str) -> str:
    """Header of a filter over the header before it, both in display order."""
    double = lambda d: hashlib.sha256(hashlib.sha256(d).digest()).digest()
    return double(double(data) + bytes.fromhex(previous)[::-1])[::-1].hex()


def block_filters(scripts: DataFrame) -> DataFrame:
    """(height, n_items, filter, filter_hash) of rows (height, block_hash, script): one filter a block, both in hex.

    Null and empty scripts are left out, repeated ones count once; a block of none has the filter of no items. A block's scripts are a task's only list, bounded as blocks are.
    """
    sets = scripts.groupBy("height", "block_hash").agg(F.collect_set(F.when(F.length("script") > 0, F.col("script"))).alias("scripts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [encode_filter(h, items) for h, items in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            hashes = [hashlib.sha256(hashlib.sha256(f).digest()).digest()[::-1].hex() for f in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([Reader(f).size() for f in made], pa.int64()), pa.array([f.hex() for f in made], pa.string()), pa.array(hashes, pa.string())], names=["height", "n_items", "filter", "filter_hash"]
            )

    return sets.mapInArrow(run, "height long, n_items long, filter string, filter_hash string")
