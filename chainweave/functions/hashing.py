"""Digests and encodings of the ledger as column functions; built-in expressions where there are any, Arrow functions elsewhere."""

from __future__ import annotations

import hashlib
import struct
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"

# RIPEMD-160: fixed values of its specification.
_RHO = (7, 4, 13, 1, 10, 6, 15, 3, 12, 0, 9, 5, 2, 14, 11, 8)
_SHIFT_L = (
    (11, 14, 15, 12, 5, 8, 7, 9, 11, 13, 14, 15, 6, 7, 9, 8),
    (7, 6, 8, 13, 11, 9, 7, 15, 7, 12, 15, 9, 11, 7, 13, 12),
    (11, 13, 6, 7, 14, 9, 13, 15, 14, 8, 13, 6, 5, 12, 7, 5),
    (11, 12, 14, 15, 14, 15, 9, 8, 9, 14, 5, 6, 8, 6, 5, 12),
    (9, 15, 5, 11, 6, 8, 13, 12, 5, 12, 13, 14, 11, 8, 5, 6),
)
_SHIFT_R = (
    (8, 9, 9, 11, 13, 15, 15, 5, 7, 7, 8, 11, 14, 14, 12, 6),
    (9, 13, 15, 7, 12, 8, 9, 11, 7, 7, 12, 7, 6, 15, 13, 11),
    (9, 7, 15, 11, 8, 6, 6, 14, 12, 13, 5, 14, 13, 13, 7, 5),
    (15, 5, 8, 11, 14, 14, 6, 14, 6, 9, 12, 9, 12, 5, 15, 8),
    (8, 5, 12, 9, 12, 5, 14, 6, 8, 13, 6, 5, 15, 13, 11, 11),
)
_ADD_L = (0x00000000, 0x5A827999, 0x6ED9EBA1, 0x8F1BBCDC, 0xA953FD4E)
_ADD_R = (0x50A28BE6, 0x5C4DD124, 0x6D703EF3, 0x7A6D76E9, 0x00000000)
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0xC3D2E1F0)


def _mix(k: int, x: int, y: int, z: int) -> int:
    return (x ^ y ^ z, (x & y) | (~x & z), (x | ~y) ^ z, (x & z) | (y & ~z), x ^ (y | ~z))[k]


def ripemd160(data: bytes) -> bytes:
    """RIPEMD-160 in plain Python, for installations whose OpenSSL lacks it."""
    mask = 0xFFFFFFFF
    roll = lambda v, n: ((v << n) | ((v & mask) >> (32 - n))) & mask
    state = list(_START)
    padded = data + b"\x80" + b"\0" * ((55 - len(data)) % 64) + struct.pack("<Q", 8 * len(data))
    for at in range(0, len(padded), 64):
        words = struct.unpack("<16I", padded[at : at + 64])
        lanes = []
        for right in (False, True):
            a, b, c, d, e = state
            order = [(9 * i + 5) % 16 if right else i for i in range(16)]
            for k in range(5):
                f, add, shifts = (4 - k, _ADD_R[k], _SHIFT_R[k]) if right else (k, _ADD_L[k], _SHIFT_L[k])
                for i in range(16):
                    t = (roll((a + _mix(f, b, c, d) + words[order[i]] + add) & mask, shifts[i]) + e) & mask
                    a, e, d, c, b = e, d, roll(c, 10), b, t
                order = [_RHO[i] for i in order]
            lanes.append((a, b, c, d, e))
        (a1, b1, c1, d1, e1), (a2, b2, c2, d2, e2) = lanes
        s = state
        state = [(s[1] + c1 + d2) & mask, (s[2] + d1 + e2) & mask, (s[3] + e1 + a2) & mask, (s[4] + a1 + b2) & mask, (s[0] + b1 + c2) & mask]
    return struct.pack("<5I", *state)


def hash160_bytes(data: bytes) -> bytes:
    return ripemd160(hashlib.sha256(data).digest())


def siphash24(k0: int, k1: int, data: bytes) -> int:
    """SipHash-2-4 of data under a 128-bit key."""
    m64 = (1 << 64) - 1
    roll = lambda v, n: ((v << n) | (v >> (64 - n))) & m64
    v = [k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573]

    def rounds(n: int) -> None:
        for _ in range(n):
            v[0] = (v[0] + v[1]) & m64
            v[1] = roll(v[1], 13) ^ v[0]
            v[0] = roll(v[0], 32)
            v[2] = (v[2] + v[3]) & m64
            v[3] = roll(v[3], 16) ^ v[2]
            v[0] = (v[0] + v[3]) & m64
            v[3] = roll(v[3], 21) ^ v[0]
            v[2] = (v[2] + v[1]) & m64
            v[1] = roll(v[1], 17) ^ v[2]
            v[2] = roll(v[2], 32)

    tail = data[len(data) // 8 * 8 :]
    blocks = [*struct.unpack(f"<{len(data) // 8}Q", data[: len(data) // 8 * 8]), int.from_bytes(tail, "little") | (len(data) & 255) << 56]
    for m in blocks:
        v[3] ^= m
        rounds(2)
        v[0] ^= m
    v[2] ^= 0xFF
    rounds(4)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def base58check(text: str) -> bytes | None:
    """Payload of a Base58Check text, without its checksum; None if it isn't one."""
    number = 0
    for c in text:
        if (k := BASE58.find(c)) < 0:
            return None
        number = number * 58 + k
    raw = b"\0" * (len(text) - len(text.lstrip("1"))) + number.to_bytes((number.bit_length() + 7) // 8, "big")
    body, check = raw[:-4], raw[-4:]
    return body if len(raw) > 4 and hashlib.sha256(hashlib.sha256(body).digest()).digest()[:4] == check else None


def segwit_program(address: str) -> tuple[str, int, bytes] | None:
    """(prefix, version, program) of a Bech32 or Bech32m address; None if it isn't one."""
    if address.lower() != address and address.upper() != address:
        return None
    prefix, _, rest = address.lower().rpartition("1")
    values = [BECH32.find(c) for c in rest]
    if not prefix or len(values) < 8 or min(values) < 0 or len(address) > 90:
        return None
    check = 1
    for x in [*(ord(c) >> 5 for c in prefix), 0, *(ord(c) & 31 for c in prefix), *values]:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ x
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            check ^= g if top >> i & 1 else 0
    version = values[0]
    if check != (1 if version == 0 else 0x2BC830A3):
        return None
    bits = 0
    for v in values[1:-6]:
        bits = bits << 5 | v
    n = 5 * (len(values) - 7)
    if n % 8 >= 5 or bits & ((1 << n % 8) - 1):
        return None
    program = (bits >> n % 8).to_bytes(n // 8, "big")
    return (prefix, version, program) if 2 <= len(program) <= 40 and version <= 16 and (version or len(program) in (20, 32)) else None


def script_of_address(address: str) -> bytes | None:
    """Output script that pays an address; None if the address is not known."""
    if (segwit := segwit_program(address)) is not None:
        _, version, program = segwit
        return bytes([version + 0x50 if version else 0, len(program)]) + program
    body = base58check(address)
    if body is None or len(body) != 21:
        return None
    if body[0] in (0x00, 0x6F):
        return b"\x76\xa9\x14" + body[1:] + b"\x88\xac"
    return b"\xa9\x14" + body[1:] + b"\x87" if body[0] in (0x05, 0xC4) else None


def work_of_bits(bits: int) -> int:
    """Expected hashes for a compact target: 2 ** 256 div (target + 1); 0 for a target of 0 or less."""
    size, word = bits >> 24, bits & 0x7FFFFF
    target = word >> 8 * (3 - size) if size <= 3 else word << 8 * (size - 3)
    return 0 if target == 0 or bits & 0x800000 else (1 << 256) // (target + 1)


def difficulty_of_bits(bits: int) -> float:
    size, word = bits >> 24, bits & 0x7FFFFF
    return float("inf") if not word else 0xFFFF / word * 2.0 ** (8 * (0x1D - size))


# Column functions. Null in, null out.


def reversed_hex(hexed: Column) -> Column:
    """Hex digits of the same bytes in the opposite order."""
    return F.array_join(F.reverse(F.split(hexed, r"(?<=\G..)")), "")


def sha256(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def double_sha256(data: Column) -> Column:
    return sha256(sha256(data))


def _per_row(f, kind: T.DataType):
    """A column function that maps f over values of an Arrow batch."""
    return F.pandas_udf(lambda s: pd.Series([None if v is None else f(v) for v in s], dtype=object), kind)


hash160 = _per_row(lambda b: hash160_bytes(bytes(b)), T.BinaryType())
base58check_decode = _per_row(base58check, T.BinaryType())
address_script = _per_row(script_of_address, T.BinaryType())
#: Work of a compact target, exact; 0 for targets so small that it has more than 38 digits, which no chain reaches.
block_work = _per_row(lambda b: Decimal(w if (w := work_of_bits(int(b))) < 10**38 else 0), T.DecimalType(38, 0))
work_hex = _per_row(lambda b: f"{work_of_bits(int(b)):064x}", T.StringType())


def short_tx_id(nonce: int):
    """Column function: the first six bytes, in hex, of SipHash of a transaction id (hex) under a nonce and its successor."""
    return _per_row(lambda t: struct.pack("<Q", siphash24(nonce, nonce + 1, bytes.fromhex(t)))[:6].hex(), T.StringType())


def varint(value: Column) -> Column:
    """Compact size encoding of a non-negative number, as hex."""
    little = lambda width: F.lower(reversed_hex(F.lpad(F.hex(value), 2 * width, "0")))
    return F.when(value < 0xFD, little(1)).when(value <= 0xFFFF, F.concat(F.lit("fd"), little(2))).when(value <= 0xFFFFFFFF, F.concat(F.lit("fe"), little(4))).otherwise(F.concat(F.lit("ff"), little(8)))


def value_bucket(value: Column) -> Column:
    """0 for 0, else a thousand for each decimal digit; digits are counted rather than taken from a logarithm, which rounds at powers of ten."""
    return F.when(value == 0, 0).otherwise(F.length(value.cast("string")) * 1000).cast("long")


def subsidy(height: Column, first: int = 5_000_000_000, halving: int = 210_000) -> Column:
    halvings = F.floor(height / halving).cast("int")
    return F.when(halvings >= 64, F.lit(0).cast("long")).otherwise(F.floor(F.lit(first) / F.pow(F.lit(2.0), halvings)).cast("long"))


def pack_id(offset: Column, length: Column) -> Column:
    """offset and length, of 20 bits, in one number; unpack_id is its inverse."""
    return F.shiftleft(offset, 20).bitwiseOR(length)


def unpack_id(packed: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(packed, 20), packed.bitwiseAND(F.lit((1 << 20) - 1))


def outpoint_key(txid: Column, vout: Column) -> Column:
    """40-byte key: the id, then the output's number, big-endian, so that keys sort as (txid, vout)."""
    return F.concat(F.unhex(txid), F.unhex(F.lpad(F.hex(vout), 16, "0")))


def address_kind(address: Column) -> Column:
    """Class of an address by its prefix and length alone."""
    n = F.length(address)
    return F.when(F.lower(address).startswith("bc1p") & (n == 62), "p2tr").when(F.lower(address).startswith("bc1q") & (n == 62), "p2wsh").when(F.lower(address).startswith("bc1q") & (n == 42), "p2wpkh").when(address.startswith("1") & n.between(26, 35), "p2pkh").when(address.startswith("3") & n.between(26, 35), "p2sh").otherwise("unknown")


def parse_payment_uri(uri: Column, scheme: str = "bitcoin") -> Column:
    """struct(address, amount in base units, label, message) of a payment URI; null for other texts. Unknown parameters are skipped, required ones make it null."""
    ok = F.lower(uri).startswith(f"{scheme}:") & ~F.lower(uri).rlike(r"[?&]req-")
    get = lambda name: F.nullif(F.regexp_extract(uri, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))
    amount = F.floor(get("amount").try_cast("decimal(20,8)") * 100_000_000).cast("long")
    return F.when(ok, F.struct(F.regexp_extract(uri, r"^[^:]+:([^?]*)", 1).alias("address"), amount.alias("amount"), F.try_url_decode(get("label")).alias("label"), F.try_url_decode(get("message")).alias("message")))


def active_rules(height: Column, activations: dict[str, int]) -> Column:
    """Names of the rules active at a height, in the order given."""
    return F.array_compact(F.array(*[F.when(height >= h, F.lit(n)) for n, h in activations.items()]))


def difficulty(bits: Column) -> Column:
    """How many times harder a compact target is than the easiest; infinite for a mantissa of 0."""
    word, size = bits.bitwiseAND(F.lit(0x7FFFFF)), F.shiftrightunsigned(bits.cast("long"), 24)
    return F.when(word == 0, F.lit(float("inf"))).otherwise(F.lit(float(0xFFFF)) / word * F.pow(F.lit(2.0), 8 * (F.lit(0x1D) - size)))


#: Cumulative work, of any integral type, as 64 hex digits.
chainwork_hex = _per_row(lambda w: f"{int(w):064x}", T.StringType())


def decode_hash32(text: Column) -> Column:
    """32 bytes of 64 hex digits; null for other texts."""
    return F.when(text.rlike("^[0-9a-fA-F]{64}$"), F.unhex(text))


def ipv6_subnet(text: str) -> str | None:
    """The first 64 bits of an IPv6 address as four groups; None if it isn't one."""
    import ipaddress

    try:
        return ":".join(ipaddress.IPv6Address(text).exploded.split(":")[:4])
    except ValueError:
        return None


subnet6 = _per_row(ipv6_subnet, T.StringType())
