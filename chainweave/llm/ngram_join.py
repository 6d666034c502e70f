"""Similarity join on word n-grams by chosen paths.

Texts are sets of shingles, n words each. Equal texts are one class, and one row, from the start. Each class gets a min-hash
embedding: place i holds the shingle that is smallest under hash i, so that two sets share it with probability equal to their Jaccard similarity.

A run deals all classes to buckets: at each node of its tree, the node's path samples places, and a class goes to the child of the shingle it
has in each of them. So classes meet in a bucket by shared sampled shingles. Nodes of few classes are leaves; larger ones are split
again, on other places, until they are small or splitting no longer parts their classes, as within a large group of near copies. Runs are repeated until a pair at
the threshold is found with the target recall.

Leaves are searched by brute force, in blocks of bounded numbers of classes and shingles, so that no group needs the memory of one task.
A pair that meets in several leaves counts in the first of them that both are in, which either's list of leaves tells. Similarities are exact:
numbers of common shingles over numbers of all. A block gives, not its pairs, but each class's number of links and edges that join the
linked classes, fewer than it has classes; rows grow with the classes, not with the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainweave.llm.common import drop_since, mapped, mark, release, stored, unused

#: Words of a shingle, and similarity from which on texts are linked, as a fraction.
WORDS, SIMILAR = 5, (4, 5)
#: Places of an embedding, and chance of a second place at a node: so a pair at the threshold stays together in one child on average.
#: From split FORK on, which few classes come to, there always is a second one.
PLACES, SECOND, FORK = 48, 0.25, 2
#: Share of pairs at the threshold that the runs are to find where each run splits them from others LEVELS times; where it does so less often, more are found.
RECALL = 0.9998
#: Classes of a node that is not split, share of its parent beyond which a node isn't split either, and levels at most.
LEAF, ALIKE, LEVELS = 48, 0.7, 6
#: Classes and shingles of a block at most, apart from what a single class has.
BLOCK, BLOCK_SHINGLES = 1024, 400_000

#: Places of a pair's sketches that agree at least, and bits of the map of classes whose texts are wanted.
AGREE, FILTER_BITS = 24, 1 << 24

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = np.random.default_rng(12).integers(1, 1 << 62, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), base)]), dtype=np.uint64)[:n]


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, start): 64-bit hashes of the shingles of text i, in the order of its words, at hashes[start[i]:start[i + 1]].

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D. A text of fewer words, but at least one, has all of them as its only
    shingle; one without words has none. Hashes of words are differences of a polynomial's prefix sums over all the texts' bytes.
    """
    joined = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    n = len(joined)
    start = np.zeros(len(texts) + 1, np.int64)
    if n == 0:
        return np.zeros(0, np.uint64), start
    space = (joined == 32) | ((joined >= 9) & (joined <= 13))
    edge = np.diff(np.concatenate([[1], space.view(np.int8), [1]]))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(begin):
        return np.zeros(0, np.uint64), start
    powers = _powers(_ODD, n)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[joined] * powers, dtype=np.uint64)])
    word = _mix((prefix[end] - prefix[begin]) * _powers(_INVERSE, n)[begin] + (end - begin).astype(np.uint64))
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(begin, text_ends)]))
    first = np.cumsum(counts) - counts
    sizes = np.where(counts >= words, counts - words + 1, (counts > 0).astype(np.int64))
    start[1:] = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = first[owner] + np.arange(start[-1]) - start[owner]
    length = np.minimum(words, counts[owner])
    out = np.zeros(start[-1], np.uint64)
    for k in range(words):
        live = k < length
        out = np.where(live, _mix(out * _ODD + word[np.minimum(at + k, len(word) - 1)] + np.uint64(k + 1)), out)
    return out, start


def _embed(hashes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(texts, PLACES) smallest hashes of non-empty sets; rows of empty sets are 0."""
    out = np.zeros((len(start) - 1, PLACES), np.int64)
    full = np.flatnonzero(np.diff(start))
    if len(full):
        for i, seed in enumerate(_SEEDS):
            h = hashes * seed
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            out[full, i] = np.minimum.reduceat(h, start[full]).view(np.int64)
    return out


def _chunks(texts: list[bytes], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes together."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def embeddings(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(key, text) to (key, n_shingles: distinct shingles, places: array of int, sketch: a byte of each place) of every text with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            for lo, hi in _chunks(texts):
                hashes, start = shingles(texts[lo:hi], words)
                owner = np.repeat(np.arange(hi - lo), np.diff(start))
                order = np.lexsort((hashes, owner))
                h, o = hashes[order], owner[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
                distinct = np.bincount(o[new], minlength=hi - lo)
                full = np.flatnonzero(distinct)
                places = _embed(hashes, start)[full].astype(np.int32)
                offsets = pa.array(np.arange(len(full) + 1, dtype=np.int32) * PLACES)
                keys = batch.column("key").slice(lo, hi - lo).take(pa.array(full))
                sketch = pa.array([row.tobytes() for row in (places & 255).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([keys, pa.array(distinct[full], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(places.ravel())), sketch], names=["key", "n_shingles", "places", "sketch"])

    return mapped(docs, run, "key binary, n_shingles bigint, places array<int>, sketch binary")


def runs_needed(recall: float = RECALL, similar: float = SIMILAR[0] / SIMILAR[1]) -> int:
    """Runs after which a pair at the threshold has met with this probability, in nodes of any level."""
    stay = math.prod(1 - (1 - similar) * (1 - second(k) * similar) for k in range(LEVELS))
    return math.ceil(math.log(1 - recall) / math.log(1 - stay))


def second(split: int) -> float:
    """Chance of a second place at a run's splits, counted from 0."""
    return SECOND if split < FORK else 1.0


def _children(path: Column, places: Column, split: int) -> Column:
    """Paths of the children that a class goes to: of one sampled place, and with a chance (see second) of another."""
    pick = lambda salt: F.pmod(F.xxhash64(F.lit(salt), path), F.lit(PLACES)).cast("int")
    child = lambda at: F.xxhash64(path, at, F.get(places, at))
    again = F.pmod(F.xxhash64(F.lit(5), path), F.lit(1000)) < int(1000 * second(split))
    one = pick(3)
    two = F.pmod(one + 1 + F.pmod(F.xxhash64(F.lit(4), path), F.lit(PLACES - 1)), F.lit(PLACES)).cast("int")
    return F.when(again, F.array(child(one), child(two))).otherwise(F.array(child(one)))


def leaves(classes: DataFrame, runs: int) -> DataFrame:
    """(key, leaf, run, n) of every class in every leaf of two classes or more, n of them; equal leaves count once.

    A level's nodes are counted; only those that are split again have rows in the next level.
    """
    total = classes.count()
    level = classes.select("key", "places", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    level = level.select("key", "run", F.explode(_children(F.xxhash64(F.lit("run"), "run"), F.col("places"), 0)).alias("leaf"))
    done = []
    for depth in range(LEVELS):
        level = stored(level, f"join-level{depth}")
        marks = F.sum(F.shiftright(F.xxhash64("key"), 32)).alias("mark"), F.bit_xor(F.xxhash64(F.lit(9), "key")).alias("mark2")
        nodes = level.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("run").alias("first"), *([F.max("parent_n").alias("parent_n")] if depth else []), *marks).filter("n > 1")
        if not depth:
            nodes = nodes.withColumn("parent_n", F.lit(total).cast("long"))
        split = (F.col("n") > LEAF) & (F.col("n") <= F.col("parent_n") * ALIKE) if depth + 1 < LEVELS else F.lit(False)
        nodes = stored(nodes.withColumn("split", split), f"join-nodes{depth}")
        done.append((level, nodes.filter(~F.col("split"))))
        if nodes.filter("split").isEmpty():
            break
        wider = (level.drop("parent_n") if depth else level).join(nodes.filter("split").select("leaf", F.col("n").alias("parent_n")), "leaf")
        # Rows that are split on take their embedding along from here, so that it is looked up once.
        wider = wider if depth else wider.join(classes.select("key", "places"), "key")
        level = wider.select("key", "run", F.explode(_children(F.col("leaf"), F.col("places"), depth + 1)).alias("leaf"), "parent_n", "places")
    # Of leaves with the same classes, one is enough: that of the first run.
    every = None
    for _, nodes in done:
        every = nodes if every is None else every.unionByName(nodes)
    kept = every.groupBy("n", "mark", "mark2").agg(F.min(F.struct("first", "leaf")).alias("one")).select("one.leaf", "n")
    kept = stored(kept, "join-leaves")
    rows = None
    for level, _ in done:
        found = level.select("key", "run", "leaf").join(kept, "leaf")
        rows = found if rows is None else rows.unionByName(found)
    return rows.dropDuplicates(["key", "leaf"])


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, rows of equal columns being side by side, with the groups' first rows and the end. What a batch ends in waits for the next."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            table = pa.Table.from_batches([*rest, batch.slice(lo, 4096)])
            new = np.zeros(table.num_rows, bool)
            new[0] = True
            for c in columns:
                v = table.column(c).to_numpy()
                new[1:] |= v[1:] != v[:-1]
            at = np.flatnonzero(new)
            if len(at) > 1:
                yield table.slice(0, at[-1]), at
            rest = table.slice(at[-1]).to_batches()
    if rest:
        table = pa.Table.from_batches(rest)
        yield table, np.asarray([0, table.num_rows])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (leaf, key) of classes that have another in their block or pair of blocks whose sketch agrees in AGREE places."""
    for table, at in _groups(batches, ["leaf", "i", "j"]):
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, PLACES)
        side, lone = table.column("side").to_numpy(), table.column("i").to_numpy() == table.column("j").to_numpy()
        keep = np.zeros(table.num_rows, bool)
        size = np.diff(at)
        two = at[:-1][size == 2]
        agree = (sketch[two] == sketch[two + 1]).sum(axis=1) >= AGREE
        agree &= lone[two] | (side[two] != side[two + 1])
        keep[two[agree]] = keep[two[agree] + 1] = True
        for lo, n in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            rows = np.arange(lo, lo + n)
            a, b = (rows, rows) if lone[lo] else (rows[side[rows] == 0], rows[side[rows] == 1])
            same = np.zeros((len(a), len(b)), np.uint8)
            for c in range(PLACES):
                same += sketch[a, c][:, None] == sketch[b, c][None, :]
            if lone[lo]:
                np.fill_diagonal(same, 0)
            near = same >= AGREE
            keep[a[near.any(axis=1)]] = True
            keep[b[near.any(axis=0)]] = True
        yield from table.filter(pa.array(keep)).select(["leaf", "key"]).combine_chunks().to_batches()


def alike(found: DataFrame, sketches: DataFrame) -> DataFrame:
    """Rows of found (key, leaf, run, n) of classes that have another of the same leaf with a sketch like theirs.

    A pair at the threshold agrees in four fifths of the places; AGREE is so far below that as to miss one in a million. Whether two classes pass
    doesn't depend on the leaf, so that what decides about first meetings stays the same.
    """
    parts = F.ceil(F.col("n") / (2 * BLOCK)).cast("int")
    rows = found.join(sketches, "key").withColumn("parts", parts)
    rows = _block_pairs(rows).select("leaf", "i", "j", "side", "key", "sketch")
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = rows.repartition(n, "leaf", "i", "j").sortWithinPartitions("leaf", "i", "j").mapInArrow(_alike, "leaf bigint, key binary")
    return found.join(kept.dropDuplicates(["leaf", "key"]), ["leaf", "key"])


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Rows with (i, j), the pairs of blocks of a leaf of `parts` blocks that a class is in, and side: 1 in block j of another i. A class of block k is in (k, k) once."""
    own = F.pmod(F.xxhash64(F.lit(8), "key"), F.col("parts")).cast("int")
    rows = rows.withColumn("k", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumns({"i": F.least("k", "o"), "j": F.greatest("k", "o"), "side": (F.col("k") > F.col("o")).cast("int")}).drop("k", "o")


def passing(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose column may be among keys: all that are, and of others few, as long as there are not much more than FILTER_BITS / 10 keys.

    A bit map of fixed size, FILTER_BITS bits, is broadcast; it only saves moving rows that a later join would drop.
    """
    position = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1
    bits = keys.select(position(F.col(column)).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    p = position(F.col(column))
    place = F.bitmap_bit_position(p).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.expr("_place_ div 8 + 1").cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumns({"bucket": F.bitmap_bucket_number(p), "_place_": place}).join(F.broadcast(bits), "bucket")
    return marked.filter(byte.bitwiseAND(F.expr("shiftleft(1, _place_ % 8)")) != 0).drop("bucket", "bits", "_place_")


def _inside(sets: list[np.ndarray], other: list[np.ndarray] | None) -> np.ndarray:
    """Numbers of common shingles of each set with each of the other sets (or of its own kind).

    Shingles that few of the sets have are counted pair by pair; those that many have, by a product of 0-1 matrices, some columns at a time.
    """
    both = sets + (other or [])
    flat = np.concatenate(both) if both else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, ids, df = np.unique(flat, return_inverse=True, return_counts=True)
    a, b = len(sets), len(other) if other is not None else len(sets)
    common = np.zeros((a, b), np.float32)
    shared = df[ids] > 1
    ids, owner, df_of = ids[shared], owner[shared], df[ids[shared]]
    rare = df_of <= 12
    order = np.argsort(ids[rare], kind="stable")
    r_ids, r_owner, r_df = ids[rare][order], owner[rare][order], df_of[rare][order]
    for step in range(1, 12):
        # The member `step` places further on has the same shingle, if the group is that long.
        if step >= len(r_ids):
            break
        same = r_ids[step:] == r_ids[:-step]
        x, y = r_owner[:-step][same], r_owner[step:][same]
        if other is None:
            np.add.at(common, (x, y), 1)
            np.add.at(common, (y, x), 1)
        else:
            across = (x < a) & (y >= a)
            np.add.at(common, (x[across], y[across] - a), 1)
    often = ~rare
    if often.any():
        columns, place = np.unique(ids[often], return_inverse=True)
        o = owner[often]
        for lo in range(0, len(columns), 4096):
            part = (place >= lo) & (place < lo + 4096)
            m = np.zeros((len(both), min(4096, len(columns) - lo)), np.float32)
            m[o[part], place[part] - lo] = 1
            common += m[:a] @ (m[a:].T if other is not None else m.T)
    if other is None:
        np.fill_diagonal(common, [len(s) for s in sets])
    return common


def _first_meeting(leaf: int, mine: list[list[int]], other: list[list[int]]) -> np.ndarray:
    """Whether `leaf` is the first of the leaves that a class of `mine` and one of `other` have in common. Lists are in one order for all."""
    before_a = [ls[: ls.index(leaf)] for ls in mine]
    before_b = [ls[: ls.index(leaf)] for ls in other]
    have = {x for ls in before_a for x in ls} & {x for ls in before_b for x in ls}
    first = np.ones((len(mine), len(other)), bool)
    rows, columns = {x: [] for x in have}, {x: [] for x in have}
    for side, members in ((before_a, rows), (before_b, columns)):
        for i, ls in enumerate(side):
            for x in ls:
                if x in have:
                    members[x].append(i)
    for x in have:
        first[np.ix_(rows[x], columns[x])] = False
    return first


def _forest(x: np.ndarray, y: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges among the given ones that join what all of them join, fewer than n."""
    up, out = list(range(n)), []

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        a, b = top(i), top(j)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


_RESULT = "key binary, other binary, links bigint"


def _search(words: int, similar: tuple[int, int]):
    """Brute force over blocks: rows of one (leaf, i, j) stand together; side 0 is block i, side 1 block j, if that is another one."""
    up, down = similar

    def block(rows: list[dict]) -> dict[str, list]:
        out = {"key": [], "other": [], "links": []}
        sides = [[r for r in rows if r["side"] == s] for s in (0, 1)]
        lone = not sides[1]
        if len(sides[0]) < 1 or (lone and (len(sides[0]) < 2 or rows[0]["i"] != rows[0]["j"])):
            return out
        sets = []
        for side in sides:
            hashes, start = shingles([r["text"] for r in side], words)
            sets.append([np.unique(hashes[start[k] : start[k + 1]]) for k in range(len(side))])
        a, b = sides[0], sides[0] if lone else sides[1]
        common = _inside(sets[0], None if lone else sets[1]).astype(np.int64)
        size_a = np.asarray([len(s) for s in sets[0]])
        size_b = size_a if lone else np.asarray([len(s) for s in sets[1]])
        linked = (up + down) * common >= up * (size_a[:, None] + size_b[None, :])
        linked &= _first_meeting(rows[0]["leaf"], [r["leaves"] for r in a], [r["leaves"] for r in b])
        if lone:
            np.fill_diagonal(linked, False)
        copies_a, copies_b = np.asarray([r["copies"] for r in a]), np.asarray([r["copies"] for r in b])
        for r, n in zip(a, linked @ copies_b, strict=True):
            if n:
                out["key"].append(r["key"])
                out["other"].append(None)
                out["links"].append(int(n))
        if not lone:
            for r, n in zip(b, copies_a @ linked, strict=True):
                if n:
                    out["key"].append(r["key"])
                    out["other"].append(None)
                    out["links"].append(int(n))
        x, y = np.nonzero(np.triu(linked) if lone else linked)
        keys = [r["key"] for r in a] + ([] if lone else [r["key"] for r in b])
        for i, j in _forest(x, y if lone else y + len(a), len(keys)):
            out["key"].append(keys[i])
            out["other"].append(keys[j])
            out["links"].append(0)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        types = [pa.binary(), pa.binary(), pa.int64()]
        at, rows = None, []
        found: dict[str, list] = {"key": [], "other": [], "links": []}

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found.values(), types, strict=True)], names=list(found))
            for v in found.values():
                v.clear()
            return out

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                for r in batch.slice(lo, 512).to_pylist():
                    here = (r["leaf"], r["i"], r["j"])
                    if here != at:
                        if rows:
                            for k, v in block(rows).items():
                                found[k] += v
                        at, rows = here, []
                        if len(found["key"]) > 10_000:
                            yield emit()
                    rows.append(r)
        if rows:
            for k, v in block(rows).items():
                found[k] += v
        yield emit()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(key, class): the smallest key of each component, for every key of edges (a, b).

    Large-star and small-star steps by turns: every node's larger neighbours, then its smaller ones, are tied to its smallest one. What is left at the end are
    stars. Edges never grow in number; each turn is written out.
    """
    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "join-edges")
    while True:
        both = now.select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(now.select(F.col("b").alias("n"), F.col("a").alias("m")))
        low = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        large = both.filter("m > n").join(low, "n").select(F.col("low").alias("a"), F.col("m").alias("b")).filter("a < b").distinct()
        # Small star: edges from the larger end; its smaller neighbours and itself are tied to the smallest.
        least = large.groupBy("b").agg(F.min("a").alias("low"))
        tied = large.join(least, "b")
        small = tied.select(F.col("low").alias("a"), F.col("a").alias("b")).filter("a < b").unionByName(least.select(F.col("low").alias("a"), "b")).distinct()
        after = stored(small, "join-edges")
        # Stars stay as they are: no node is both the smaller and the larger end of edges, nor the larger end of two.
        crossing = after.select(F.col("a").alias("n")).distinct().join(after.select(F.col("b").alias("n")).distinct(), "n", "left_semi")
        twice = after.groupBy("b").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
        now = after
        if crossing.isEmpty() and twice.isEmpty():
            break
    return now.select(F.col("b").alias("key"), F.col("a").alias("class")).unionByName(now.select(F.col("a").alias("key"), F.col("a").alias("class")).distinct())


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similar: tuple[int, int] = SIMILAR, recall: float = RECALL) -> DataFrame:
    """(key, class_id, n_links, copies): each document's class, the smallest key of all that links join it to; how many other documents its text is
    linked with, copies of it included; and how many documents have exactly its text.

    Documents are linked if their texts are equal or their sets of shingles have a Jaccard similarity of at least `similar` (a fraction). Null texts and texts without a
    word have no shingles and no links, and each such document is its own class. A text of fewer words than a shingle has one shingle, of all
    its words. Repeated rows are copies of each other. Null keys are grouped like others; the class of documents that all have null keys is null.
    An empty table gives an empty one. Only key and text are read, so that other columns' names don't matter.
    """
    start = mark()
    worded = F.length(F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))) > 0
    raw = docs.select(docs[f"`{key}`"].alias("id"), docs[f"`{text}`"].cast("string").alias("text"))
    keyed = raw.select("id", "text", F.coalesce(worded, F.lit(False)).alias("worded"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"))
    members = stored(keyed.select("id", "worded", "key"), "join-members")
    classes = members.filter("worded").groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes, "join-classes")
    places = embeddings(keyed.filter("worded").select("key", F.col("text").cast("binary").alias("text")), words)
    places = stored(places.groupBy("key").agg(F.min(F.struct("n_shingles", "places", "sketch")).alias("p")).select("key", "p.*"), "join-places")
    before = mark()
    met = stored(leaves(places, runs_needed(recall, similar[0] / similar[1])), "join-met")
    found = stored(alike(met, places.select("key", "sketch")).join(places.select("key", "n_shingles"), "key"), "join-found")
    drop_since(docs.sparkSession, before, found)
    # A class's leaves, in the order of runs, for telling where a pair meets first.
    mine = found.groupBy("key").agg(F.max("n_shingles").alias("n_shingles"), F.array_sort(F.collect_list(F.struct("run", "leaf"))).alias("l")).select("key", "n_shingles", F.col("l.leaf").alias("leaves"))
    sizes = found.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    sizes = sizes.select("leaf", parts.alias("parts"))
    texts = keyed.filter("worded").select("id", "key", F.col("text").cast("binary").alias("text"))
    needed = stored(mine.join(classes, "key"), "join-needed")
    # Of a class's documents, the first one's text; rows that repeat a document repeat its text.
    payload = passing(texts, needed, "key").join(needed.withColumnRenamed("id", "first"), "key").filter(F.col("id").eqNullSafe(F.col("first"))).drop("id", "first").dropDuplicates(["key"])
    rows = payload.withColumn("leaf", F.explode("leaves")).join(sizes, "leaf")
    rows = _block_pairs(rows).select("leaf", "i", "j", "side", "key", "copies", "leaves", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = rows.repartition(n, "leaf", "i", "j").sortWithinPartitions("leaf", "i", "j", "side", "key")
    links = stored(mapped(blocks, _search(words, similar), _RESULT), "join-links")
    drop_since(docs.sparkSession, start, members, classes, links)
    counts = links.filter("other IS NULL").groupBy("key").agg(F.sum("links").alias("links"))
    joined = components(links.filter("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b")))
    named = classes.join(joined, "key", "left").withColumn("class", F.coalesce("class", "key"))
    # The class's name: the smallest key of its documents.
    ids = named.groupBy("class").agg(F.min("id").alias("class_id"))
    named = named.join(ids, "class").join(counts, "key", "left").select("key", "class_id", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = stored(named, "join-named")
    drop_since(docs.sparkSession, start, members, named)
    some = members.filter("worded").join(named, "key").select(F.col("id").alias(key), "class_id", "n_links", "copies")
    none = members.filter("NOT worded").select(F.col("id").alias(key), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("copies"))
    return some.unionByName(none)


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the documents whose class has one of smaller key; of rows that share that key, one stays. Rows with null keys, which no key tells apart, all stay.

    Documents without a word are classes of their own, so that they stay; see join for long texts and empty tables. Columns pass through as they are.
    """
    name = F.col(f"`{key}`")
    chosen, number = unused(docs, "chosen", "number")
    first = join(docs, key, text, **options).select(F.col("class_id").alias(chosen)).filter(F.col(chosen).isNotNull()).distinct()
    named = docs.filter(name.isNotNull()).join(first, name == F.col(chosen), "left_semi")
    one = F.row_number().over(Window.partitionBy(name).orderBy(F.xxhash64(F.col(f"`{text}`"))))
    return named.withColumn(number, one).filter(F.col(number) == 1).drop(number).unionByName(docs.filter(name.isNull()))
