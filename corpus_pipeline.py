"""A pipeline from raw documents to encoded training data.

STAGES lists (name, function) in order. Each function takes (spark, docs, sf_dir), docs being what the stage before it returned, read again from
Parquet, and gives a DataFrame; all but the last give the columns of documents. Part of the training-data subpackage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainweave.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from chainweave.llm.common import drop_since, mark, stored, table
from chainweave.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model, fitted on labelled rows of documents and labels, scores below 0.5.

    Null and empty texts stay. Whole texts are scored, however long; repeated rows stay or go together. Without labels of both classes, and from an empty table, nothing is taken.
    """
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(*COLUMNS), model, keep_text=True)
    return scored.filter(F.col("predicted") == 0).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sources show.

    Null texts stay null, with null n_chars; a text of nothing but such lines becomes empty. A null source is one source. Repeated rows stay as they are; an empty table stays empty.
    """
    clean = line_dedup.remove_shared_lines(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group that near-duplicate links join.

    Null and empty texts are groups of their own and stay, and so do rows with a null doc_id; of rows that share the smallest doc_id one stays. An empty table stays empty.
    """
    return ngram_join.first_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, a row for each round.

    Texts without a word, null ones among them, are never taken. A null source is one source. Repeated rows are documents of their own; ties of the shuffle go by doc_id, size and text. An empty table stays empty.
    """
    mixed = mixing.mixed_documents(docs.select(*COLUMNS))
    return mixed.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token_ids of each document, with digests of them and of what they decode to.

    Null texts count as empty. Texts are encoded whole; each row of the mix is encoded by itself; an empty table gives an empty one.
    """
    return bpe.encode_documents(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), keep_text=False)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_join", keep_one_of_similar),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: SQL can't express a fitted network, nor what follows from it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again; what a stage wrote besides goes then."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before = mark()
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
            drop_since(spark, before, docs)
    return docs
