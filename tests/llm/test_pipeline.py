"""The pipeline's stages by rule on a small corpus."""

import random

from chainweave.llm import mixing, ngram_join


def test_stages_and_their_effects(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mix", "bpe"]
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(240):
        words = [rnd.choice(vocab) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for _ in range(5):
                words[rnd.randrange(60)] = rnd.choice(["zzslur", "zzfoul", "zznasty"])
        rows.append((i, " ".join(words) + "\nboiler plate everywhere", "en", f"s{i % 13}", 0))
        labels.append((i, 1, int(bad)))
    rows += [(1000 + i, rows[2 * i + 1][1].replace("\n", " extra\n"), "en", "s1", 0) for i in range(5)] + [(2000, None, "en", None, None), (2001, "", "en", "s0", 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d).cache()
        out[name] = docs.collect()
    clean = {r["doc_id"] for r in out["toxicity"]}
    wrong = sum((i in clean) == (i % 4 == 0) for i in range(240))
    assert wrong <= 5
    assert all("boiler" not in (r["text"] or "") for r in out["line_dedup"]) and len(out["line_dedup"]) == len(out["toxicity"])
    ids = {r["doc_id"] for r in out["ngram_join"]}
    assert ids <= clean and not any(1000 + i in ids for i in range(5) if 2 * i + 1 in clean) and {2000, 2001} <= ids
    taken = sum(len((r["text"] or "").split()) for r in out["mix"])
    size = sum(len((r["text"] or "").split()) for r in out["ngram_join"])
    assert abs(taken - 1.5 * size) < 0.02 * size + 2
    assert len(out["bpe"]) == len(out["mix"]) and all(r["n_tokens"] == len(r["token_ids"]) for r in out["bpe"])


def test_first_of_each_keeps_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None), (3, None)], "doc_id long, text string")
    assert sorted(map(str, ngram_join.first_of_each(docs).collect())) == sorted(["Row(doc_id=1, text='a b c d e f')", "Row(doc_id=None, text='a b c d e f')", "Row(doc_id=3, text=None)"])


def test_unknown_sources_are_mixed(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, "c d", None)], "doc_id long, text string, source string")
    assert sum(r["taken"] for r in mixing.mixed_sizes(docs).collect()) == 6
