"""Byte-pair encoding by dynamic programming over prefixes.

For every prefix of a piece of text exactly one vocabulary token can be the last of its encoding.
An automaton over the vocabulary reports, at each position, the tokens that are suffixes of the prefix;
a token is the last one if it starts the piece, or if the last token of the shorter prefix and it stay two
tokens when merged (a test on the pair alone). Back-pointers from the end of the piece give the ids that merging by
rank gives, in time linear in the piece, however long it is.

Texts are cut as the tokenizer's own pattern cuts them. Encodings of frequent pieces are kept in bounded caches.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chainweave.llm.common import held, mapped, unused

#: Entries kept in each cache of a Python worker.
CACHE_ENTRIES = 200_000
#: Pairs of tokens whose test is kept in a Python worker.
PAIR_ENTRIES = 250_000
#: Pieces longer than this are not cached.
CACHE_CHARS = 64
#: Characters from which on a piece's table is packed.
LONG_PIECE = 1 << 16
#: Added to the code of the last character of a word where the vocabulary marks word ends.
END = 0x4000


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(extra)
            extra += 1
    return [table[b] for b in range(256)]


class Bounded(dict):
    """Results of a function of one string, computed when missing; when full, the oldest quarter goes."""

    def __init__(self, compute, entries: int = CACHE_ENTRIES) -> None:
        super().__init__()
        self.compute, self.entries = compute, entries

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.entries:
                for old in list(islice(self, self.entries // 4)):
                    del self[old]
            self[key] = value
        return value


class PrefixBpe:
    """A byte-level BPE vocabulary in the tokenizers library's JSON format.

    encode(piece) and prefix_counts(piece) work on one piece of pre-tokenized text.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if kinds not in ([], ["NFC", "Replace", "Lowercase"]):
            raise ValueError(f"normalizers {kinds} are not supported")
        self.lowers = bool(kinds)
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [spec["pre_tokenizer"]]
        split = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split"]
        #: The byte-level step's own pattern, which the format leaves implicit.
        own = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.keeps_space = not split
        self.pattern = regex.compile(split[0] if split else own)
        chars = byte_chars()
        self.to_chars = {b: c for b, c in enumerate(chars)}
        to_byte = {c: b for b, c in enumerate(chars)}
        vocab = model["vocab"]
        self.rank, self.left, self.right, self.pair_rank = {}, {}, {}, {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            whole = vocab[a + b]
            x, y = vocab[a], vocab[b]
            self.rank[whole], self.left[whole], self.right[whole] = r, x, y
            self.pair_rank[x, y] = r
        self.token_bytes: dict[int, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        words: dict[str, int] = {}
        self.lengths: dict[int, int] = {}
        for token, i in vocab.items():
            body = token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token
            if body and all(c in to_byte for c in body):
                self.token_bytes[i] = bytes(to_byte[c] for c in body)
                key = body if body == token else body[:-1] + chr(ord(body[-1]) + END)
                self.lengths[i] = len(key)
                words[key] = i
        for content, i in self.special.items():
            self.token_bytes[i] = content.encode()
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        for key, i in words.items():
            if self.reachable(i):
                self.automaton.add_word(key, (i, len(key)))
        self.automaton.make_automaton()

    def symbols(self, piece: str) -> str:
        s = piece.encode("utf-8").decode("latin-1").translate(self.to_chars)
        return s[:-1] + chr(ord(s[-1]) + END) if self.suffix and s else s

    def stays(self, a: int, b: int) -> bool:
        """Whether tokens a and b, side by side, are not merged across their border.

        Goes back in time from the finished tokens to their bytes. Beside the border stand x and y; each was merged
        away at x_end and y_end. The pair (x, y) merges first if its rank is lower; among equal ranks the leftmost goes first.
        """
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is not None:
            return known
        rank, x, y = self.rank, a, b
        x_end = y_end = 1 << 60
        good = True
        while True:
            m = self.pair_rank.get((x, y))
            if m is not None and m < x_end and m <= y_end:
                good = False
                break
            rx, ry = rank.get(x, -1), rank.get(y, -1)
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                x_end, x = rx, self.right[x]
            else:
                y_end, y = ry, self.left[y]
        if len(self.pairs) >= PAIR_ENTRIES:
            for old in list(islice(self.pairs, PAIR_ENTRIES // 4)):
                del self.pairs[old]
        self.pairs[key] = good
        return good

    def reachable(self, token: int) -> bool:
        """Whether merging the token's own bytes ends in this one token."""
        known = self.whole.get(token)
        if known is None:
            if token not in self.rank:
                known = True
            else:
                x, y = self.left[token], self.right[token]
                known = self.reachable(x) and self.reachable(y) and self._joins(x, y)
            self.whole[token] = known
        return known

    def _joins(self, x: int, y: int) -> bool:
        """Whether x and y survive side by side until the very merge of both."""
        r = self.pair_rank[x, y]
        del self.pair_rank[x, y]
        self.pairs.pop(x << 20 | y, None)
        try:
            return self.stays(x, y)
        finally:
            self.pair_rank[x, y] = r
            self.pairs.pop(x << 20 | y, None)

    def table(self, symbols: str) -> tuple[list[int], list[int]]:
        """For every prefix: its last token, and its number of tokens (both at 0 for the empty prefix; -1: none)."""
        n = len(symbols)
        # Four bytes a place for long pieces; lists are quicker for short ones.
        last, count = ([-1] * (n + 1) if n < LONG_PIECE else array("i", [-1]) * (n + 1) for _ in range(2))
        count[0] = 0
        known, stays = self.pairs.get, self.stays
        for end, (token, length) in self.automaton.iter(symbols):
            i = end + 1
            if last[i] >= 0:
                continue
            start = i - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                ok = known(before << 20 | token)
                if ok is None:
                    ok = stays(before, token)
                if not ok:
                    continue
            last[i], count[i] = token, count[start] + 1
        return last, count

    def last_tokens(self, symbols: str) -> list[int]:
        """The last token of every prefix but the empty one, by the place where it ends (-1: none): table without counts."""
        n = len(symbols)
        last = [-1] * n if n < LONG_PIECE else array("i", [-1]) * n
        known, stays = self.pairs.get, self.stays
        for end, (token, length) in self.automaton.iter(symbols):
            if last[end] < 0:
                start = end - length
                if start < 0:
                    last[end] = token
                else:
                    before = last[start]
                    if before >= 0:
                        ok = known(before << 20 | token)
                        if ok or ok is None and stays(before, token):
                            last[end] = token
        return last

    def encode(self, piece: str) -> list[int]:
        s = self.symbols(piece)
        last = self.last_tokens(s)
        i, out, lengths = len(s) - 1, [], self.lengths
        while i >= 0:
            token = last[i]
            if token < 0:
                raise ValueError("the vocabulary lacks a byte of this text")
            out.append(token)
            i -= lengths[token]
        out.reverse()
        return out

    def normal(self, text: str) -> str:
        """The text as the vocabulary's normalizer leaves it, white space aside. Lower case goes by character."""
        if not self.lowers:
            return text
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(map(str.lower, text))

    def has_special(self, text: str) -> bool:
        return any(map(text.__contains__, self.special))

    def plain_pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text that holds no special token."""
        return self.pattern.findall(self.normal(text))

    def pieces(self, text: str) -> list[str | int]:
        """Pre-tokens of a text; special tokens as their ids."""
        if not self.has_special(text):
            return self.plain_pieces(text)
        out: list[str | int] = []
        for k, part in enumerate(self.special_pattern.split(text)):
            out += [self.special[part]] if k % 2 else self.pattern.findall(self.normal(part))
        return out


def spaced_evenly(text: str) -> bool:
    """Whether single spaces and line ends, never side by side, are all the white space; then texts may be cut at spaces before the pattern is applied."""
    return len(text.split()) == text.count(" ") + text.count("\n") + 1


class TextEncoder:
    """Whole texts to ids, as packed little-endian unsigned 32-bit integers, and back."""

    def __init__(self, path: str) -> None:
        self.bpe = PrefixBpe(path)
        self.by_piece = Bounded(self._piece)
        self.by_chunk = Bounded(self._chunk)

    def _piece(self, piece: str) -> bytes:
        ids = self.bpe.encode(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk of a text without special tokens, and of the space before it. One that is a single piece is kept as a chunk only."""
        pieces = self.bpe.plain_pieces(" " + chunk)
        if len(pieces) == 1:
            return self.by_piece.get(pieces[0]) or self._piece(pieces[0])
        return b"".join(map(self.by_piece.__getitem__, pieces))

    def _packed(self, text: str) -> bytes:
        return b"".join(struct.pack("<I", p) if isinstance(p, int) else self.by_piece[p] for p in self.bpe.pieces(text))

    def packed(self, text: str) -> bytes:
        if not self.bpe.keeps_space or not spaced_evenly(text) or self.bpe.has_special(text):
            return self._packed(text)
        first, *rest = text.split(" ")
        return self._packed(first) + b"".join(map(self.by_chunk.__getitem__, rest))

    def ids(self, text: str) -> list[int]:
        return list(struct.unpack(f"<{len(b := self.packed(text)) // 4}I", b))

    def decode_packed(self, packed: bytes) -> str:
        ids = array("I")
        ids.frombytes(packed)
        return b"".join(map(self.bpe.token_bytes.__getitem__, ids)).decode("utf-8", errors="replace")

    def decode(self, ids: list[int]) -> str:
        return self.decode_packed(struct.pack(f"<{len(ids)}I", *ids))


def encoder(path: str) -> TextEncoder:
    """One encoder a Python worker, kept between batches and tasks."""
    return held(("encoder", path), lambda: TextEncoder(path))


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """docs without its text column, and n_tokens, token_ids (array of int), decoded (string), ids_sha256, decoded_sha256.

    vocabulary: path of a tokenizers JSON file that every executor can read.
    Null texts are encoded as empty ones: no ids and an empty decoded text. Texts are encoded whole, however long. Repeated rows
    give repeated results; an empty table gives an empty one. Other columns pass through, except those with the names
    of results, in any case, which results replace.
    """
    string = T.StringType()
    results = [("n_tokens", T.LongType()), *([("token_ids", T.ArrayType(T.IntegerType()))] if keep_ids else []), *([("decoded", string)] if keep_text else []), ("ids_sha256", string), ("decoded_sha256", string)]
    names = [n for n, _ in results]
    others = [f for f in docs.schema if f.name != text and f.name.lower() not in names]
    (read,) = unused(docs, "text_read")
    source = docs.select(*[docs[f"`{f.name}`"] for f in others], docs[f"`{text}`"].cast("string").alias(read))
    schema = T.StructType(list(others))
    for n, t in results:
        schema = schema.add(n, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for lo in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(lo, 256)
                out: dict[str, list] = {n: [] for n in names}
                for value in part.column(read):
                    packed = enc.packed(value.as_py() or "")
                    decoded = enc.decode_packed(packed)
                    out["n_tokens"].append(len(packed) // 4)
                    out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                    if keep_ids:
                        ids = array("I")
                        ids.frombytes(packed)
                        out["token_ids"].append(ids.tolist())
                    if keep_text:
                        out["decoded"].append(decoded)
                kinds = {"n_tokens": pa.int64(), "token_ids": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in others), *(pa.array(out[n], kinds.get(n, pa.string())) for n in names)],
                    names=[*(f.name for f in others), *names],
                )

    return mapped(source, run, schema)
