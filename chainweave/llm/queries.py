"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainweave.llm import ann, bpe, chat, line_dedup, mixing, ngram_join, quality_rules, token_counts, toxicity, warc
from chainweave.llm.common import table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, installed on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, vocabulary("byte_bpe_50k.json"), keep_ids=False, keep_text=False)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archived(table(spark, sf_dir, "pages"))
    return read.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.withColumn("held_out", toxicity.held_out(F.col("doc_id"))), model)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_messages(chat.tool_trace(table(spark, sf_dir, "conversations")), chat.TRACE_TOOLS)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, vocabulary("word_bpe_49k.json"), limit=2048)


def op10_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(ann.build_index(vectors), vectors.filter(F.col("vec_id") % 20 == 0))


QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_bpe_round_trip, op3_ngram_join, op4_warc, op5_toxicity, op6_mix_sources, op7_chat_format, op8_line_dedup, op9_token_counts, op10_ann_search)
}
ORACLES: dict[str, str] = {"op4_warc": warc.ORACLE, "op6_mix_sources": mixing.ORACLE, "op7_chat_format": chat.ORACLE, "op8_line_dedup": line_dedup.ORACLE}
