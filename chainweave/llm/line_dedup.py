"""Removal of lines that many sites share.

A line's spread is the number of distinct sites that show it. Long lines are shared by chance more rarely than short ones, so that fewer sites decide
over them. HyperLogLog sketches per line hash, merged by aggregation, estimate every line's spread in one pass. Estimates so near the threshold that the sketch can't decide are counted exactly, over those lines only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweave.llm.common import SPACE_CHARS, SPACES, drop_since, mark, stored

#: Distinct sites from which on a line is boilerplate.
MIN_SITES = 10
#: The same for lines of LONG_WORDS words or more: more sites than copies of one document usually have, and so few that a passage in a
#: dozen documents reaches them though one site holds a third of all rows.
LONG_SITES = 5
LONG_WORDS = 50
#: log2 of a sketch's buckets.
LG_K = 10
#: Estimates within so many standard errors of the threshold are counted exactly.
NEAR = 6.0


def _hashes(line: Column) -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2")]


def _has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(SPACE_CHARS))) > 0


def _is_long(line: Column) -> Column:
    return F.regexp_count(line, F.lit(f"[^{SPACES}]+")) >= LONG_WORDS


def _site(site: Column) -> Column:
    return F.when(site.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), site.cast("string")))


def shared_lines(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source", long_sites: int = LONG_SITES) -> DataFrame:
    """Hashes (h1, h2) of the lines with a word that at least min_sites distinct sites show, or long_sites if the line is long. A null site is a site of its own."""
    lines = docs.select(_site(docs[f"`{site}`"]).alias("site"), F.explode(F.split(docs[f"`{text}`"], "\n")).alias("line"))
    lines = lines.filter(_has_word(F.col("line"))).select("site", _is_long(F.col("line")).alias("long"), *_hashes(F.col("line")))
    error = NEAR * 1.04 / 2 ** (LG_K / 2)
    spread = lines.groupBy("h1", "h2", "long").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    least = F.when(F.col("long"), F.lit(min(min_sites, long_sites))).otherwise(F.lit(min_sites))
    spread = spread.select("h1", "h2", least.alias("least"), F.hll_sketch_estimate("sketch").alias("sites"))
    found = stored(spread.filter(F.col("sites") >= F.col("least") * (1 - error) - 1), "line-spread")
    sure = F.col("sites") > F.col("least") * (1 + error) + 1
    exact = (
        lines.join(found.filter(~sure).select("h1", "h2", "least"), ["h1", "h2"])
        .groupBy("h1", "h2", "least", "site")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("h1", "h2", "least")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= F.col("least"))
    )
    return stored(found.filter(sure).select("h1", "h2").unionByName(exact.select("h1", "h2")), "shared-lines")


def remove_shared_lines(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source", key: str = "doc_id", long_sites: int = LONG_SITES) -> DataFrame:
    """docs with its text column cleaned, and n_lines (lines with a word before), n_removed (lines taken out).

    A line, what stands between line feeds, is taken out of every document if min_sites or more distinct sites show it (long_sites for lines
    of LONG_WORDS words or more), first occurrence included; a null site is one site. Lines without a word stay. A document that has only such lines keeps its row, with
    an empty text. Null texts stay null, with 0 lines. Documents are told apart by key and text, nulls equal, so that repeated rows get repeated results.
    Long texts are read whole. An empty table gives an empty one. Other columns pass through, except those with the names of results, which results replace.
    """
    docs = docs.drop("n_lines", "n_removed")
    before = mark()
    shared = shared_lines(docs, min_sites, text, site, long_sites)
    drop_since(docs.sparkSession, before, shared)
    k, t = docs[f"`{key}`"], docs[f"`{text}`"]
    keyed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), t.alias("t"), F.xxhash64(k, t).alias("k1"), F.xxhash64(F.lit(3), t, k).alias("k2"))
    lines = keyed.select("k1", "k2", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    lines = lines.filter(_has_word(F.col("line"))).select("k1", "k2", "pos", *_hashes(F.col("line")))
    gone = lines.join(shared, ["h1", "h2"]).groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone"))
    joined = keyed.select("doc", "k1", "k2").join(gone, ["k1", "k2"], "left").withColumn("parts", F.split(F.col("doc")[text], "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    whole = F.col("doc")[text]
    clean = F.when(F.col("gone").isNull(), whole).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("parts"), i)), "\n"))
    columns = [clean.alias(text) if c == text else F.col("doc")[c].alias(c) for c in docs.columns]
    n_lines = F.when(whole.isNull(), 0).otherwise(F.size(F.filter("parts", _has_word))).cast("long")
    return joined.select(*columns, n_lines.alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, source FROM documents),
l AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
shared AS (SELECT line FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
  GROUP BY line HAVING count(DISTINCT coalesce('=' || source, 'null')) >= CASE WHEN len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= {LONG_WORDS} THEN {min(MIN_SITES, LONG_SITES)} ELSE {MIN_SITES} END),
m AS (SELECT l.*, shared.line IS NOT NULL AS gone, regexp_matches(l.line, '[^\\x20\\x09-\\x0D]') AS worded FROM l LEFT JOIN shared ON l.line = shared.line),
a AS (SELECT rid, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS t, count(*) FILTER (worded) AS n_lines, count(*) FILTER (gone) AS n_removed FROM m GROUP BY rid)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(a.t, '') END AS text,
  coalesce(a.n_lines, 0)::BIGINT AS n_lines, coalesce(a.n_removed, 0)::BIGINT AS n_removed
FROM d LEFT JOIN a ON d.rid = a.rid
"""
