"""Operators on texts against plain versions of them, and their edge cases."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chainweave.llm import bpe, line_dedup, mixing, ngram_join, quality_rules, token_counts
from chainweave.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = ["", None, " \n\t ", "a", "a b c", "x" * 3000, "é漢字 ΑΣ İ <|endoftext|> 'll  two\n\n \r\x0b\x0c spaces", "same same same same same", "l1\nl1\n\nl1", " lead trail \n"]


def docs_of(spark, texts, **more):
    rows = [(i, t, f"s{i % 3}" if i % 5 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def repeated(words):
    found = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({j for i in range(len(words) - 2) if found[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})


def test_statistics(spark):
    rnd = random.Random(4)
    texts = EDGE + [" ".join(rnd.choice("ab c# !A 1".split()) for _ in range(rnd.randint(1, 60))) + rnd.choice(["\n", ""]) for _ in range(60)]
    got = {r["doc_id"]: r for r in quality_rules.text_statistics(docs_of(spark, texts, n_words="clash")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), repeated(words))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, t


def test_rules_are_learned(spark):
    rnd = random.Random(5)
    good = [" ".join(rnd.choice("abcdefgh") * 3 + str(rnd.randint(0, 99)) for _ in range(80)) for _ in range(150)]
    junk = [" ".join(rnd.choice("abcdefgh") * 3 + str(rnd.randint(0, 99)) + "###" for _ in range(80)) for _ in range(60)]
    docs = docs_of(spark, good + junk)
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(210)] + [(None, 0), (3, None)], "doc_id long, quality int")
    rows = quality_rules.judge(docs, labels).collect()
    assert all(r["kept"] == (r["doc_id"] < 150) for r in rows) and len(rows) == 210
    none = quality_rules.judge(docs.limit(0), labels)
    assert none.count() == 0
    unlabelled = quality_rules.judge(docs_of(spark, EDGE), labels.limit(0)).collect()
    assert all(r["base_failed"] and not r["kept"] for r in unlabelled)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encodings_are_the_library_s(name):
    from tokenizers import Tokenizer

    rnd = random.Random(6)
    texts = [t or "" for t in EDGE] + ["".join(rnd.choice("a aab  \n\t'sé'llßΣİ漢1²½٣<|endoftext|>!?　\xa0\x1c\x85́") for _ in range(50)) for _ in range(200)]
    texts += ["a" * n for n in range(1, 80)] + [" " * n + "x" for n in range(1, 40)] + [chr(c) + "a " + chr(c) * 2 for c in range(0, 0x2100, 3)]
    library = Tokenizer.from_file(vocabulary(name))
    library.no_truncation()
    library.no_padding()
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    if name.startswith("byte"):
        own = bpe.encoder(vocabulary(name))
        assert [own.ids(t) for t in texts] == want
        assert [own.decode(ids) for ids in want] == [library.decode(ids, skip_special_tokens=False) for ids in want]
    else:
        own = token_counts.counter(vocabulary(name))
        assert [own.count(t) for t in texts] == [len(ids) for ids in want]
        for word in ("running", "unbelievable", "thhawhble", "straße", "漢字"):
            assert own.word_prefix_counts(word) == [0] + [len(library.encode(word[:i], add_special_tokens=False).ids) for i in range(1, len(word) + 1)]
        long = "some words that go on, and on; unbelievably so. " * 5
        for budget in range(0, 60, 7):
            cut = own.truncate(long, budget)
            assert own.count(cut) <= budget and long.startswith(cut)
            assert own.count(long[: len(cut) + 12]) > budget


def test_encoded_documents(spark):
    docs = docs_of(spark, EDGE, n_tokens="clash", ids_sha256=1)
    rows = {r["doc_id"]: r for r in bpe.encode_documents(docs, vocabulary("byte_bpe_50k.json")).collect()}
    assert len(rows) == len(EDGE)
    for i, t in enumerate(EDGE):
        assert rows[i]["decoded"] == (t or "") and rows[i]["n_tokens"] == len(rows[i]["token_ids"])
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0
    counts = {r["doc_id"]: r for r in token_counts.count_tokens(docs, vocabulary("word_bpe_49k.json"), limit=3).collect()}
    assert counts[1]["n_tokens"] == 0 and counts[4]["n_tokens"] == 3 and not counts[4]["over_limit"] and counts[6]["n_bytes"] == len(EDGE[6].encode())


def test_line_dedup(spark):
    sites = [f"s{i}" for i in range(14)] + [None]
    rows = [(i, "own line %d\nshared by all\n\n  \nshared by few" % i if i < 11 else "shared by all\nlast %d" % (i % 2), s) for i, s in enumerate(sites)]
    rows += [(99, None, "s1"), (100, "", "s2"), (101, "shared by all", "s3"), (101, "shared by all", "s3"), (None, "shared by all\nx", "s4")]
    rows += [(200 + i, "one site only", "s0") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_lines", F.lit("clash"))
    got = sorted(line_dedup.remove_shared_lines(docs, min_sites=10).select("doc_id", "text", "n_lines", "n_removed").collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    spread = {}
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if WORD.search(line):
                spread.setdefault(line, set()).add(s)
    want = []
    for i, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        gone = [len(spread.get(x, ())) >= 10 for x in lines]
        want.append((i, None if t is None else "\n".join(x for x, g in zip(lines, gone) if not g), sum(bool(WORD.search(x)) for x in lines), sum(gone)))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    assert line_dedup.remove_shared_lines(docs.limit(0)).count() == 0


def test_long_lines_need_fewer_sites(spark):
    rnd = random.Random(11)
    names = ["big"] + [f"s{i}" for i in range(19)]
    draw = lambda: rnd.choices(names, [9.5] + [1] * 19)[0]
    long = {n: " ".join(f"p{n}w{k}" for k in range(50)) for n in (2, 3, 4, 5, 6, 9, 10)}
    rows = [(f"own {i}", draw()) for i in range(300)]
    # A passage in n sites, most of its documents in the one that holds a third of all rows; one word less makes it short.
    for n, line in long.items():
        for s in ["big"] * 6 + names[1:n]:
            rows.append((f"{line}\n{line[: line.rindex(' ')]}\ntail {len(rows)}", s))
    assert sum(s == "big" for _, s in rows) >= len(rows) / 3
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.remove_shared_lines(docs).collect()}
    for i, (t, _) in enumerate(rows):
        lines = t.split("\n")
        if len(lines) == 3:
            n = next(n for n, line in long.items() if line == lines[0])
            lines = lines[:1] * (n < 5) + lines[1:2] * (n < 10) + lines[2:]
        assert got[i] == lines
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], columns=["doc_id", "text", "source"]))
    assert {i: t.split("\n") for i, t in con.sql(f"SELECT doc_id, text FROM ({line_dedup.ORACLE})").fetchall()} == got


def levels(sizes, weights, share, most):
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, out, free = share * sum(sizes.values()), {}, set(names)
    while free:
        total = sum(w[n] for n in free)
        over = {n for n in free if left * w[n] / total > most * sizes[n]}
        if not over:
            return out | {n: left * w[n] / total for n in free}
        for n in over:
            out[n] = most * sizes[n]
        left -= sum(out[n] for n in over)
        free -= over
    return out


def test_mix(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join("w%d" % rnd.randint(0, 9) for _ in range(rnd.choice([0, 1, 5, 40, 300]))), rnd.choice(["a", "a", "a", "b", "é", None, "c"])) for i in range(300)]
    rows += [(7, None, "b"), (8, "twin twin", "a"), (8, "twin twin", "a"), (None, "no key", "c"), (None, "no key", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mixed_sizes(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = levels(sizes, (3, 1, 2), 1.5, 2)
    by_target = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert any(abs(r["target"] - t) < 1e-6 * max(1, t) and r["source_size"] == sizes[s] for s, t in want.items())
        by_target.setdefault((r["source_size"], round(r["target"], 3)), []).append(r["taken"])
    for (size, target), taken in by_target.items():
        assert abs(sum(taken) - target) <= 0.01 * sum(sizes.values()) + 2, (size, target, sum(taken))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_sizes(docs.repartition(3)).collect()))
    assert mixing.mixed_sizes(docs.limit(0)).count() == 0
    mixed = mixing.mixed_documents(docs.drop("size")).collect()
    assert sum(len(WORD.findall(r["text"])) for r in mixed) == sum(r["taken"] for r in got)


def test_small_sources_are_mixed_at_any_size(spark, monkeypatch):
    # Blocks of 500 words, as a far larger input would have.
    monkeypatch.setattr(mixing, "MIN_SLOTS", 600)
    sizes = {"big": 190_000, "few": 2, "one": 40, "some": 700, "tiny": 130, None: 9_000}
    rows = [(s, k) for s, n in sizes.items() for k in range(0, n, 100)]
    docs = spark.createDataFrame([(i, "w " * min(100, sizes[s] - k), s) for i, (s, k) in enumerate(rows)], "doc_id long, text string, source string")
    taken, words = Counter(), Counter()
    for r in mixing.mixed_sizes(docs).collect():
        taken[rows[r["doc_id"]][0]] += r["taken"]
    for r in mixing.mixed_documents(docs).collect():
        words[r["source"]] += len(WORD.findall(r["text"]))
    want = levels(sizes, (3, 1, 2), 1.5, 2)
    assert all(abs(taken[s] - t) <= max(1, 0.01 * t) for s, t in want.items()), (taken, want)
    assert words == taken
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    known = con.sql(f"SELECT doc_id, taken FROM ({mixing.ORACLE.replace('/ 131072)', '/ 600)')})").fetchall()
    assert dict(known) == {r["doc_id"]: r["taken"] for r in mixing.mixed_sizes(docs).collect()}


def jaccard_links(texts):
    def grams(t):
        w = WORD.findall(t or "")
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [grams(t) for t in texts]
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    common = Counter((a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :])
    return {(a, b) for (a, b), n in common.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)}


def classes_of(n, links):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return [top(i) for i in range(n)]


def test_ngram_join(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 40)
    monkeypatch.setattr(ngram_join, "LEAF", 8)
    rnd = random.Random(9)
    vocab = ["w%d" % i for i in range(500)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(20, 120))] for _ in range(40)]
    passage = [rnd.choice(vocab) for _ in range(60)]
    texts = [None, "", " ", "a b", "a b", "a  b", "a b c"] + [" ".join(b) for b in base] + [" ".join(passage + b[:30]) for b in base]
    for b in base[:20]:
        for _ in range(rnd.randint(1, 4)):
            c = list(b)
            for _ in range(rnd.randint(0, 2)):
                c[rnd.randrange(len(c))] = "new%d" % rnd.randint(0, 9)
            texts.append(" ".join(c))
    near = [rnd.choice(vocab) for _ in range(150)]
    for i in range(120):
        c = list(near)
        c[rnd.randrange(150)] = "n%d" % i
        texts.append(" ".join(c))
    texts += [" ".join(near)] * 5
    links = jaccard_links(texts)
    want_class, degree = classes_of(len(texts), links), Counter(x for pair in links for x in pair)
    docs = docs_of(spark, texts, class_id="clash", key="k")
    got = {r["doc_id"]: r for r in ngram_join.join(docs).collect()}
    assert len(got) == len(texts)
    assert {i: r["class_id"] for i, r in got.items()} == dict(enumerate(want_class))
    assert {i: r["n_links"] for i, r in got.items()} == {i: degree[i] for i in got}
    assert ngram_join.join(docs.limit(0)).count() == 0
    kept = {r["doc_id"] for r in ngram_join.first_of_each(docs).collect()}
    assert kept == set(want_class)


def test_shingles_do_not_depend_on_neighbours():
    texts = [b"", b"one two three four five six", b" one  two\tthree\nfour five six ", b"x"]
    hashes, start = ngram_join.shingles(texts)
    assert list(start[1:] - start[:-1]) == [0, 2, 2, 1]
    assert list(hashes[:2]) == list(hashes[2:4])
    alone, _ = ngram_join.shingles([b"one two three four five six"])
    assert list(alone) == list(hashes[:2])
