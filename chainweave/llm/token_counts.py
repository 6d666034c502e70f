"""Exact token counts of every prefix of a text."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chainweave.llm.bpe import END, Bounded, PrefixBpe
from chainweave.llm.common import held, mapped, unused


class PrefixCounter:
    """Token counts of texts and of all their prefixes, without encoding a prefix again.

    Counts at the ends of prefixes come from the table that dynamic programming over a piece leaves. Where the vocabulary marks
    word ends, a prefix that ends within a word gets the marked last token that fits what stands before it.
    """

    def __init__(self, path: str) -> None:
        self.bpe = PrefixBpe(path)
        self.by_piece = Bounded(lambda p: self.piece_counts(p)[-1])
        self.by_chunk = Bounded(self._count)

    def piece_counts(self, piece: str) -> list[int]:
        """Tokens of a whole piece at its end; before it, of the bytes up to each position as parts of the longer word."""
        counts = self.bpe.table(self.bpe.symbols(piece))[1]
        if counts[-1] < 0:
            raise ValueError("the vocabulary lacks a byte of this text")
        return counts

    def _count(self, text: str) -> int:
        by_piece = self.by_piece
        return sum(1 if isinstance(p, int) else by_piece[p] for p in self.bpe.pieces(text))

    def count(self, text: str) -> int:
        """Pieces of a vocabulary that drops white space never hold a space, so each chunk between spaces is counted once."""
        if self.bpe.keeps_space:
            return self._count(text)
        return sum(map(self.by_chunk.__getitem__, text.split(" ")))

    def word_prefix_counts(self, piece: str) -> list[int]:
        """For each number of characters of a piece, the tokens of that prefix as a word of its own; one table for all of them."""
        bpe = self.bpe
        if not bpe.suffix:
            table = bpe.table(bpe.symbols(piece))[1]
            ends, at = [0], 0
            for c in piece:
                at += len(c.encode("utf-8"))
                ends.append(at)
            return [table[e] for e in ends]
        raw = piece.encode("utf-8").decode("latin-1").translate(bpe.to_chars)
        last, count = bpe.table(raw)
        out, at = [0], 0
        for c in piece:
            at += len(c.encode("utf-8"))
            marked = chr(ord(raw[at - 1]) + END)
            best = None
            for start in range(max(0, at - self.longest), at):
                token, _ = bpe.automaton.get(raw[start : at - 1] + marked, (-1, 0))
                if token >= 0 and (start == 0 or last[start] >= 0 and bpe.stays(last[start], token)):
                    best = count[start] + 1
                    break
            out.append(best)
        return out

    @property
    def longest(self) -> int:
        return max(self.bpe.lengths.values())

    def prefix_counts(self, text: str) -> list[tuple[int, int]]:
        """(characters of the normalized text, tokens so far) at the end of each piece."""
        text = self.bpe.normal(text)
        out, total = [(0, 0)], 0
        for m in self.bpe.pattern.finditer(text):
            total += self.by_piece[m[0]]
            out.append((m.end(), total))
        return out

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of the normalized text that ends with a character of a piece and has at most budget tokens."""
        text = self.bpe.normal(text)
        ends = self.prefix_counts(text)
        k = bisect_right([n for _, n in ends], budget) - 1
        cut, used = ends[k]
        if k + 1 < len(ends) and (m := self.bpe.pattern.search(text, cut)):
            inner = self.word_prefix_counts(m[0])
            for chars in range(len(m[0]) - 1, 0, -1):
                if inner[chars] is not None and used + inner[chars] <= budget and len(self.bpe.pattern.findall(m[0][:chars])) == 1:
                    return text[: m.start() + chars]
        return text[:cut]


def counter(path: str) -> PrefixCounter:
    """One counter a Python worker, kept between batches and tasks."""
    return held(("counter", path), lambda: PrefixCounter(path))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """docs without its text column, and n_bytes, n_tokens, over_limit (n_tokens > limit).

    vocabulary: path of a tokenizers JSON file that every executor can read. Null texts count as empty: 0 bytes, 0 tokens.
    Whole texts are counted, however long; repeated rows give repeated results; an empty table gives an empty one. Other columns
    pass through, except those with the names of results, which results replace.
    """
    names = ["n_bytes", "n_tokens", "over_limit"]
    others = [f for f in docs.schema if f.name != text and f.name.lower() not in names]
    (read,) = unused(docs, "text_read")
    source = docs.select(*[docs[f"`{f.name}`"] for f in others], docs[f"`{text}`"].cast("string").alias(read))
    schema = T.StructType(list(others)).add("n_bytes", T.LongType()).add("n_tokens", T.LongType()).add("over_limit", T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            tokens, sizes = [], []
            for value in batch.column(read):
                t = value.as_py() or ""
                sizes.append(len(t.encode("utf-8")))
                tokens.append(count(t))
            arrays = [*(batch.column(f.name) for f in others), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(f.name for f in others), *names])

    return mapped(source, run, schema)
