"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots of equal numbers of words. Slot i has the point i * golden ratio mod 1, which the cumulative target weights map to a
source; points of that sequence are spread so evenly that each source's slots come near its share in every stretch of the mix.
A source's slots, ranked, take the blocks of its shuffled words one after the other, and go round again after the last.
A source whose target is few blocks is cut into blocks of its own, spread evenly over the slots, the last cut to end at the target, so that
it is met however large the mix.

Nothing is ordered in one task: ranks and running sums are made of sums over buckets and orders within buckets, and the
number of buckets grows with the square root of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainweave.llm.common import SPACES, stored

#: Slots that a mix has at least, if it has that many words.
MIN_SLOTS = 1 << 17
#: Words of a slot at most.
BLOCK_WORDS = 1 << 16
#: Blocks that a source's target is cut into at most, if it is fewer blocks of the common size than that.
SMALL_BLOCKS = 256
#: The golden ratio's fraction of 2 ** 32, odd: successive multiples mod 2 ** 32 are the points.
GOLDEN = 2654435769
#: Shares of the sources in turn, in order of their names.
WEIGHTS = (3.0, 1.0, 2.0)


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def _name(source: Column) -> Column:
    """Sorts by code point with null last, and keeps null apart from every string."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(name, source_size) to those and target: share of all sizes, dealt by weight, at most `most` times a source's size.

    What a source can't take is dealt again by weight. The end of that is a level L with target = min(most * size, L * weight): sources fill up in order of
    most * size / weight, and L follows from the sums over those that are full. The table has a row for each source.
    """
    by_name, by_need = Window.orderBy("name"), Window.orderBy("need", "name")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("need", F.col("cap") / F.col("weight"))
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(share)).withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    # The first source that the level of its step doesn't fill sets the level of all that follow; theirs are lower.
    t = t.withColumn("level", F.max(F.when(F.col("level") < F.col("need"), F.col("level"))).over(Window.partitionBy()))
    return t.select("name", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _buckets(n: int) -> int:
    return max(16, math.isqrt(max(0, n)) + 1)


def _offsets(rows: DataFrame, keys: list[str], bucket: str, value: str) -> DataFrame:
    """Sum of value over the lower buckets of the same keys, for each bucket. A row for each bucket, so few enough for a window."""
    sums = rows.groupBy(*keys, bucket).agg(F.sum(value).alias("_s_"))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, bucket, F.coalesce(F.sum("_s_").over(w), F.lit(0)).cast("long").alias("offset"))


def schedule(plan: DataFrame, slots: int) -> DataFrame:
    """(name, low, high) to (slot, name, rank): low <= point < high. Ranks count a source's slots from 0.

    plan has a row for each source; the points' ranges don't overlap.
    """
    spark = plan.sparkSession
    width = _buckets(slots)
    points = spark.range(slots).select(F.col("id").alias("slot"), F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(1 << 32)).alias("point"), F.expr(f"id div {width}").alias("bucket"))
    # Ranges and points meet in cells of the points' space, so that the join has an equal key; a range has a row in each of its cells.
    cells = plan.withColumn("cell", F.explode(F.sequence(F.shiftright("low", 20), F.shiftright(F.col("high") - 1, 20))))
    met = points.withColumn("cell", F.shiftright("point", 20)).join(cells, "cell").filter("point >= low AND point < high")
    chosen = met.select("slot", "bucket", "name", F.lit(1).alias("one"))
    ahead = _offsets(chosen, ["name"], "bucket", "one")
    within = F.row_number().over(Window.partitionBy("name", "bucket").orderBy("slot")) - 1
    return chosen.withColumn("within", within).join(ahead, ["name", "bucket"]).select("slot", "name", (F.col("offset") + F.col("within")).alias("rank"))


def blocks(plan: DataFrame, block: int) -> DataFrame:
    """plan with block (words of a source's blocks) and most (words that it gives in all, for small sources only, else null)."""
    most = F.when((F.col("target") > 0) & (F.col("target") < SMALL_BLOCKS * block), F.greatest(F.lit(1), F.round("target")).cast("long"))
    own = F.ceil(F.col("most") / F.lit(SMALL_BLOCKS)).cast("long")
    return plan.withColumn("most", most).withColumn("block", F.when(F.col("most").isNull(), F.lit(block).cast("long")).otherwise(own))


def small_schedule(plan: DataFrame, slots: int) -> DataFrame:
    """(slot, name, rank) of the blocks of small sources (see blocks), at even distances, each source from a place of its own on."""
    n = F.ceil(F.col("most") / F.col("block")).cast("long")
    ranks = plan.filter("most IS NOT NULL").select("name", n.alias("n"), F.posexplode(F.sequence(F.lit(1), n)).alias("rank", "_"))
    offset = F.pmod(F.xxhash64("name"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return ranks.select(F.floor((F.col("rank") + offset) * F.lit(slots) / F.col("n")).cast("long").alias("slot"), "name", F.col("rank").cast("long").alias("rank"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(doc: a struct of all columns of docs, with size, r1 and r2; key, size, source_size, target, r1 and r2; pieces; schedule).

    r1 and r2, 128 bits, stand for a document's key, text and source; rows equal in all of these have the same.

    The schedule has a row for each slot of a large source and for each block of a small one (see blocks).
    pieces: slot, name, r1, r2, copy (a number among equal rows), round (0 first, 1 second time a document is taken), start and words (the words that the slot takes of
    that document). Documents of a source are shuffled by a digest of seed and key; equal digests go by key, size and text digest, and rows equal in all of
    these are interchangeable. Null texts have size 0; a null source is a source of its own, last in order; null keys have a digest of
    their own. Documents without a word are never taken. Very long texts are blocks of many slots. An empty table gives empty results. Other columns' names don't matter.
    """
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(docs[f"`{key}`"].cast("string"), F.lit("null"))))
    k, t = docs[f"`{key}`"], docs[f"`{text}`"]
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    keyed = docs.select(whole.alias("doc"), k.alias("key"), _name(docs[f"`{source}`"]).alias("name"), words_in(t).alias("size"), order.alias("order"), F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(5), t).alias("t2"))
    keyed = keyed.select("doc", "key", "name", "size", "order", F.xxhash64("key", "size", "t1", "name").alias("r1"), F.xxhash64(F.lit(6), "name", "t2", "size", "key").alias("r2"))
    slim = stored(keyed.select("name", "size", "order", "r1", "r2", "key"), "mix-sizes")
    # Rows equal in all columns stand together; a copy's place among them is told by a number.
    sources = slim.groupBy("name").agg(F.sum("size").alias("source_size"))
    plan = stored(targets(sources, weights, share, most), "mix-targets")
    (wanted,) = plan.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()
    rows = slim.count()
    block = max(1, min(BLOCK_WORDS, math.ceil(wanted / MIN_SLOTS)))
    slots = math.ceil(wanted / block)
    to_end = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, 0)
    scale = F.lit(float(1 << 32)) / F.lit(max(wanted, 1.0))
    cut = plan.withColumn("high", F.round(F.sum("target").over(to_end) * scale).cast("long")).withColumn("last", F.max("high").over(Window.partitionBy()))
    cut = cut.withColumn("high", F.when(F.col("high") == F.col("last"), F.lit(1 << 32)).otherwise(F.col("high")))
    cut = cut.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("name")), F.lit(0))).filter("high > low")
    sized = blocks(plan, block)
    large = cut.join(sized.filter("most IS NULL").select("name"), "name", "left_semi")
    slot_table = stored(schedule(large.select("name", "low", "high"), slots).unionByName(small_schedule(sized, slots)), "mix-schedule")
    # Each document's first word among its source's shuffled words.
    n = _buckets(rows)
    bucketed = slim.filter("size > 0").withColumn("bucket", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * F.lit(n) / F.lit(1 << 32)))
    ahead = _offsets(bucketed, ["name"], "bucket", "size")
    w = Window.partitionBy("name", "bucket").orderBy("order", "key", "size", "r1", "r2")
    placed = bucketed.withColumn("within", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("copy", F.row_number().over(Window.partitionBy("name", "bucket", "r1", "r2").orderBy("order")))
    placed = placed.join(ahead, ["name", "bucket"]).select("name", "r1", "r2", "copy", "size", (F.col("offset") + F.coalesce("within", F.lit(0))).alias("first"))
    # Blocks that a document shares in, in each round; the source's words go round, so the second round's places follow the first's.
    rounds = placed.join(sized.select("name", "source_size", "block", "most"), "name").withColumn("round", F.explode(F.array(*map(F.lit, range(math.ceil(most))))))
    rounds = rounds.withColumn("first", F.col("first") + F.col("round") * F.col("source_size")).withColumn("end", F.least(F.col("first") + F.col("size"), F.col("most"))).filter("end > first")
    spans = rounds.withColumn("rank", F.explode(F.sequence(F.expr("first div block"), F.expr("(end - 1) div block"))))
    start = F.greatest(F.col("first"), F.col("rank") * F.col("block"))
    end = F.least(F.col("end"), (F.col("rank") + 1) * F.col("block"))
    spans = spans.select("name", "rank", "r1", "r2", "copy", "round", (start - F.col("first")).alias("start"), (end - start).alias("words"))
    pieces = slot_table.join(spans, ["name", "rank"]).select("slot", "name", "r1", "r2", "copy", "round", "start", "words")
    return keyed.select("doc", "size", "r1", "r2"), slim.join(plan, "name"), pieces, slot_table


def mixed_sizes(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """key, size, source_size, target and taken (words that the mix takes of the document, repeats counted) of every document."""
    _, sized, pieces, _ = mix(docs, key=key, **options)
    taken = pieces.groupBy("r1", "r2", "copy").agg(F.sum("words").alias("taken"))
    numbered = _numbered(sized.select(F.col("key").alias(key), "size", "source_size", "target", "r1", "r2"))
    return numbered.join(taken, ["r1", "r2", "copy"], "left").select(key, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with the number of each among those of the same r1 and r2, which are equal in key, text and source."""
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy("r1", "r2").orderBy("size")))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that the mix takes, with the columns of docs; one row for each round that takes any of it.

    A document that a round takes in full keeps its text; where the mix ends within a document, the words taken stand with single blanks
    between them. Documents without a word, null texts among them, are never taken. See mix for nulls, ties, repeated rows and empty tables.
    """
    columns = docs.columns
    sized, _, pieces, _ = mix(docs, key=key, text=text, **options)
    rounds = pieces.groupBy("r1", "r2", "copy", "round").agg(F.sum("words").alias("taken"), F.min("start").alias("start"))
    rows = _numbered(sized).join(rounds, ["r1", "r2", "copy"])
    whole = F.col("doc")[text]
    part = F.array_join(F.slice(F.split(F.btrim(whole, F.lit(" \t\n\x0b\x0c\r")), f"[{SPACES}]+"), (F.col("start") + 1).cast("int"), F.col("taken").cast("int")), " ")
    cut = F.when(F.col("taken") >= F.col("size"), whole).otherwise(part)
    return rows.select(*[cut.alias(text) if c == text else F.col("doc")[c].alias(c) for c in columns])


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('0' || source, '1') AS name, text, source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS ord FROM documents),
s AS (SELECT name, sum(size)::BIGINT AS source_size FROM d GROUP BY name),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY name) - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
n AS (SELECT *, cap / weight AS need FROM w),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY need, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS full_,
    sum(weight) OVER (ORDER BY need, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM n),
v AS (SELECT *, max(CASE WHEN (total - full_) / open_ < need THEN (total - full_) / open_ END) OVER () AS level FROM f),
t AS (SELECT name, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM v),
p AS (SELECT sum(target) AS wanted, greatest(1, least({BLOCK_WORDS}, ceil(sum(target) / {MIN_SLOTS})))::BIGINT AS block FROM t),
h AS (SELECT name, round(sum(target) OVER (ORDER BY name ROWS UNBOUNDED PRECEDING) * (4294967296.0::DOUBLE / greatest(wanted, 1.0)))::BIGINT AS high FROM t, p),
h2 AS (SELECT name, CASE WHEN high = max(high) OVER () THEN 4294967296 ELSE high END AS high FROM h),
r AS (SELECT name, high, coalesce(lag(high) OVER (ORDER BY name), 0) AS low FROM h2),
slots AS (SELECT (i * {GOLDEN}) % 4294967296 AS point FROM p, unnest(range(ceil(wanted / block)::BIGINT)) AS u(i)),
g AS (SELECT r.name, count(*) * any_value(p.block) AS taken FROM slots JOIN r ON point >= low AND point < high, p GROUP BY r.name),
k AS (SELECT t.name, CASE WHEN t.target > 0 AND t.target < {SMALL_BLOCKS} * p.block THEN greatest(1, round(t.target)::BIGINT) ELSE coalesce(g.taken, 0) END AS taken FROM t CROSS JOIN p LEFT JOIN g ON g.name = t.name),
o AS (SELECT *, row_number() OVER () AS rid, coalesce(sum(size) OVER (PARTITION BY name ORDER BY ord, doc_id, size, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM d)
SELECT o.doc_id, o.size, t.source_size, t.target,
  (greatest(0, least(o.size, coalesce(k.taken, 0) - o.first)) + greatest(0, least(o.size, coalesce(k.taken, 0) - t.source_size - o.first)))::BIGINT AS taken
FROM o JOIN t ON o.name = t.name LEFT JOIN k ON o.name = k.name
"""
