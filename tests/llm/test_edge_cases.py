"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables, and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chainweave.llm import ann, bpe, chat, line_dedup, mixing, ngram_join, quality_rules, token_counts, toxicity, warc
from chainweave.llm.queries import vocabulary

LONG = "long " * 200_000
TEXTS = [(1, None, "a"), (2, "", "a"), (3, " \n ", None), (4, "one two three four five six", "b"), (4, "one two three four five six", "b"), (5, LONG, "b"), (None, "x", None), (None, None, None), (6, "x", "a"), (7, "\x00\ufeff\U0001f600 <|endoftext|>", "a")]
#: Names that operators use, or might, for columns of their own, in some other case too.
CLASHES = """text_read row copy taken name order round start size source_size target rank slot doc t t1 r1 r2 k1 k2 k key gone parts pos line h1 h2 words lines windows ordered places
    id y part o class_id n_links copies leaf run n i j side leaves links first dim shard vector query_id SCORE Predicted n_tokens N_BYTES ids_sha256 kept rule base_failed n_words mark labelled body place depth calls answers content message
    payload digest bytes address header kind refers_to record_type n_lines n_removed other class low high cell bucket""".split()
LABELS = [(4, 0, 1), (5, 1, 0), (None, 1, 1), (6, None, None), (7, 1, 0), (7, 0, 1)]


def documents(spark, clash):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.lit(0).cast("long")})
    return docs.withColumns({c: F.lit("clash") for c in CLASHES}) if clash else docs


def labels(spark, clash):
    out = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    return out.withColumns({c: F.lit("clash") for c in CLASHES}) if clash else out


OPERATORS = {
    "quality": lambda s, d, c: quality_rules.judge(d, labels(s, c)),
    "statistics": lambda s, d, c: quality_rules.text_statistics(d),
    "bpe": lambda s, d, c: bpe.encode_documents(d, vocabulary("byte_bpe_50k.json")),
    "join": lambda s, d, c: ngram_join.join(d),
    "toxicity": lambda s, d, c: toxicity.score(d, toxicity.train(d, labels(s, c)), keep_text=True),
    "sizes": lambda s, d, c: mixing.mixed_sizes(d),
    "lines": lambda s, d, c: line_dedup.remove_shared_lines(d, min_sites=2),
    "tokens": lambda s, d, c: token_counts.count_tokens(d, vocabulary("word_bpe_49k.json")),
    "archive": lambda s, d, c: warc.archived(d.withColumnsRenamed({"doc_id": "page_id", "source": "url", "text": "html"})),
    "chat": lambda s, d, c: chat.format_messages(d.withColumnsRenamed({"doc_id": "conv_id", "source": "role"}).withColumn("turn", F.lit(0).cast("long"))),
    "trace": lambda s, d, c: chat.format_messages(chat.tool_trace(d.withColumnsRenamed({"doc_id": "conv_id"}).withColumns({"turn": F.lit(1).cast("long"), "role": F.lit("assistant")})), chat.TRACE_TOOLS),
}
STAGES = {name: lambda s, d, c, f=f: f(s, d, s.conf.get("test.tables")) for name, f in corpus_pipeline.STAGES}


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_cases(spark, name):
    plain = OPERATORS[name](spark, documents(spark, False), False)
    kept = rows(plain)
    assert len(kept) == len(TEXTS)
    clashing = OPERATORS[name](spark, documents(spark, True), True)
    # Results are the same whatever other columns there are.
    mine = [c for c in plain.columns if c in clashing.columns]
    assert set(plain.columns) == set(mine) and rows(clashing.select(*[clashing[f"`{c}`"] for c in plain.columns])) == kept
    assert rows(OPERATORS[name](spark, documents(spark, False).limit(0), False)) == []


def test_mixed_documents_with_clashes(spark):
    plain, clashing = mixing.mixed_documents(documents(spark, False)), mixing.mixed_documents(documents(spark, True))
    assert rows(clashing.select(*plain.columns)) == rows(plain) and set(CLASHES) <= set(clashing.columns)
    assert mixing.mixed_documents(documents(spark, False).limit(0)).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_edge_cases(spark, name, tmp_path):
    docs = documents(spark, False)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, False).write.parquet(f"{tmp_path}/labels.parquet")
    spark.conf.set("test.tables", str(tmp_path))
    plain = STAGES[name](spark, docs, False)
    assert plain.count() > 0 and rows(STAGES[name](spark, documents(spark, True), True)) == rows(plain)
    assert STAGES[name](spark, docs.limit(0), False).count() == 0
    if name != "bpe":
        assert plain.columns == corpus_pipeline.COLUMNS


def test_neighbours_on_edge_cases(spark):
    vectors = [(20, [1e200, 1.0]), (2, [1e200, 2.0]), (3, [1e-200, 1e-200]), (4, [-1e200, 0.0]), (40, [1e-200, 0.0]), (40, [1e-200, 0.0]), (5, None), (6, []), (None, [1.0, 1.0]), (7, [0.0, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in CLASHES})
    got = ann.search(ann.build_index(df), df.filter("vec_id % 20 = 0")).collect()
    assert [(r["query_id"], r["vec_id"]) for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))] == [(20, 2), (20, 3), (20, 40), (20, 4), (40, 2), (40, 20), (40, 3), (40, 4)]
