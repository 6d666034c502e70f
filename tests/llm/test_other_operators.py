"""Archive, toxicity, chat and nearest neighbours against plain versions, round trips and held-out rows, and their edge cases."""

import base64
import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chainweave.llm import ann, chat, toxicity, warc


def test_archive_round_trip(spark, tmp_path):
    rows = [(5, "http://a/é", "same"), (2, "http://b\r\nX: y", "same"), (9, None, None), (7, "u", ""), (3, "v", "x" * 50_000), (3, "v", "x" * 50_000), (3, "w", "other"), (None, "n", "same"), (None, "n", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    path = warc.write_archive(pages, f"{tmp_path}/a")
    read = warc.read_archive(spark, path).cache()
    got = read.collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        response = first.get(h or "") == i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else first[h or ""]))
    key = lambda r: str(r)
    assert sorted([(r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=key) == sorted(want, key=key)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in rows})
    records = warc.warc_bytes(read).agg(F.collect_list("record").alias("r")).first()["r"]
    joined = spark.createDataFrame([(b"".join(map(bytes, records)),), (None,)], "content binary")
    parsed = warc.parse_warc(joined).collect()
    assert sorted(r["header"] for r in parsed) == sorted(r["header"] for r in got)
    assert all(bytes(r["block"]) in {(h or "").encode() for _, _, h in rows} for r in parsed)
    assert warc.archived(pages.limit(0)).count() == 0


def test_archive_is_verified(spark, tmp_path):
    path = warc.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), f"{tmp_path}/a")
    spark.createDataFrame([(hashlib.sha256(b"text").hexdigest(), 4, b"tess")], "address string, bytes long, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(PySparkException):
        warc.read_archive(spark, path).collect()


def corpus(n, seed):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    texts, y = [], []
    for _ in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([8, 40, 150]))]
        y.append(int(rnd.random() < 0.25))
        for _ in range(y[-1] * max(1, len(words) // 30)):
            words[rnd.randrange(len(words))] = rnd.choice(["zzkrat", "zzkramp", "Zzkror!", "foulish"])
        texts.append(" ".join(words))
    return texts, y


def test_toxicity_on_held_out_texts(spark):
    texts, y = corpus(500, 1)
    model = toxicity.fit(texts, y)
    fresh, want = corpus(300, 2)
    got = toxicity.Scorer(model).scores(fresh) >= 0.5
    assert np.mean(got == np.asarray(want, bool)) > 0.95
    long = " ".join(["clean"] * 5000 + ["zzkrat", "foulish", "zzkrat"] + ["clean"] * 5000)
    rows = [(0, None), (1, ""), (2, " "), (3, fresh[0]), (3, fresh[0]), (4, long)]
    df = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")), model)
    scored = {r["doc_id"]: r for r in df.collect()}
    assert df.count() == 6 and scored[0]["score"] == scored[1]["score"] == scored[2]["score"] < 0.5
    assert scored[4]["predicted"] == 1 and abs(scored[3]["score"] - toxicity.Scorer(model).scores([fresh[0]])[0]) < 1e-5
    assert toxicity.score(spark.createDataFrame(rows, "doc_id long, text string").limit(0), model).count() == 0
    empty = toxicity.fit([], [])
    assert toxicity.Scorer(empty).scores(["any words"])[0] < 0.5


def plain_logit(model, words):
    """The network over one window, a step and a word at a time."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    x = [model.inputs(toxicity.forms([w]))[0].astype(float) for w in words]
    states, n = [], toxicity.HIDDEN
    for layer, order in zip(model.layers, (range(len(x)), reversed(range(len(x)))), strict=True):
        h, out = np.zeros(n), {}
        for i in order:
            p = x[i] @ layer["w"] + layer["b"]
            z, r = sigmoid(p[:n] + h @ layer["u"][:, :n]), sigmoid(p[n : 2 * n] + h @ layer["u"][:, n : 2 * n])
            h = (1 - z) * h + z * np.tanh(p[2 * n :] + (r * h) @ layer["u"][:, 2 * n :])
            out[i] = h
        states.append(out)
    if not x:
        return float(model.attend["bias"][0])
    both = [np.concatenate([states[0][i], states[1][i]]) for i in range(len(x))]
    e = np.exp([np.tanh(s @ model.attend["key"]) @ model.attend["query"] for s in both])
    return float(sum(w * s for w, s in zip(e / e.sum(), both, strict=True)) @ model.attend["out"] + model.attend["bias"][0])


def test_network_against_plain_steps():
    texts, y = corpus(200, 8)
    model = toxicity.fit(texts, y)
    for t in [*texts[:25], "", "a", "ab", "abc", "\u00e9", " ".join(["long"] * 100) + " zzkrat"]:
        words = t.lower().split()
        starts = range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)
        want = max(plain_logit(model, words[s : s + toxicity.WINDOW]) for s in starts)
        assert math.isclose(toxicity.Scorer(model).logits([t])[0], want, rel_tol=1e-3, abs_tol=1e-3), t


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_short_and_empty_texts(spark, seed):
    for words in ([], ["a"], ["."], ["ab"], ["abc"], ["a", "b"]):
        f = toxicity.forms(words)
        assert len(f.words) == len(words) and (np.diff(f.start) >= 1).all() and f.start[-1] == len(f.flat)
    texts, y = corpus(150, seed)
    texts += ["a", "b", "", " ", "zzkrat", "."]
    y += [0, 1, 1, 0, 1, 0]
    model = toxicity.fit(texts, y, seed)
    for t in ("a", "zz", "abc", "\u00e9"):
        assert 0 <= toxicity.Scorer(model).scores([t])[0] <= 1
    assert (toxicity.Scorer(model).scores(["", " ", "\n\t", "  \x0c"]) < 0.5).all()
    one = toxicity.score(spark.createDataFrame([(1, "a")], "doc_id long, text string").withColumn("text_read", F.lit(1)), model).collect()
    assert len(one) == 1 and one[0]["text_read"] == 1
    # Words of one half only, and none at all.
    assert toxicity.fit(["a", "b"], [0, 1]).words.shape == toxicity.fit(["", ""], [0, 1]).words.shape


def test_gradients(monkeypatch):
    texts, y = corpus(20, 3)
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    model = toxicity.fit(texts, y)
    for halves in (2, 1):
        picked = [(i % halves, t.split()[:20], v) for i, (t, v) in enumerate(zip(texts, y, strict=True))]
        target, weigh = np.asarray(y, np.float32), np.ones(len(y), np.float32)

        def loss(picked=picked, target=target):
            index, mask = np.zeros((toxicity.WINDOW, len(picked)), int), np.zeros((toxicity.WINDOW, len(picked)), bool)
            words = sorted({w for _, ws, _ in picked for w in ws})
            for j, (_, ws, _) in enumerate(picked):
                index[: len(ws), j], mask[: len(ws), j] = [words.index(w) for w in ws], True
            x = model.inputs(toxicity.forms(words))
            z = toxicity.window_logits(model, [x @ layer["w"] + layer["b"] for layer in model.layers], index, mask).astype(float)
            return float(np.mean(np.log1p(np.exp(-z * (2 * target - 1)))))

        grads = toxicity._gradients(model, toxicity.Words(picked, [model.prior, model.prior]), np.arange(len(picked)), target, weigh)
        rnd = np.random.default_rng(0)
        for name, value in model.parameters().items():
            g = grads[name].ravel()
            at = int(np.argmax(np.abs(g))) if name in ("words", "grams") else int(rnd.integers(value.size))
            old = value.ravel()[at]
            flat = value.reshape(-1)
            flat[at] = old + 1e-2
            up = loss()
            flat[at] = old - 1e-2
            down = loss()
            flat[at] = old
            assert math.isclose((up - down) / 2e-2, g[at], rel_tol=0.08, abs_tol=2e-4), name


def test_long_labelled_texts_are_learned_from(spark):
    texts, y = corpus(300, 5)
    rnd = random.Random(6)
    texts = [t + " " + " ".join(rnd.choice(["lorem", "ipsum", "dolor"]) for _ in range(2000)) for t in texts]
    docs = spark.createDataFrame([*enumerate(texts), (0, "zzkrat " * 5), (None, "x"), (900, None)], "doc_id long, text string").withColumn("y", F.lit(1))
    labels = spark.createDataFrame([*enumerate(y), (0, None), (None, 1), (900, 1), (901, 1)], "doc_id long, toxic int").withColumn("id", F.lit("clash"))
    model = toxicity.train(docs, labels)
    fresh, want = corpus(200, 7)
    got = toxicity.Scorer(model).scores([t + " lorem ipsum dolor" * 700 for t in fresh]) >= 0.5
    assert np.mean(got == np.asarray(want, bool)) > 0.9
    assert not toxicity.train(docs, labels.limit(0)).prior.any()


def test_training_ignores_held_out_labels(spark):
    texts, y = corpus(120, 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert one.shift == two.shift and np.array_equal(one.words, two.words)


SCHEMAS = {"add": {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "number"}}, "additionalProperties": False}}


def test_chat(spark):
    call = lambda **x: f"<tool_call>{json.dumps(x)}</tool_call>"
    result = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    rows = [
        (1, 0, "user", 'say "hi"\n\u20ac'),
        (1, 1, "assistant", "ok " + call(id="c1", name="add", arguments={"b": 2.0, "a": 1}) + call(id="c2", name="add", arguments={"a": "$c1", "b": 1})),
        (1, 3, "tool", result("c2", {"z": 1, "a": [1.5]})),
        (1, 2, "tool", result("c1", "3")),
        (1, 4, "tool", result("nobody", "x")),
        (1, 5, "assistant", call(id="c3", name="add", arguments={"a": -1}) + "<tool_call>{bad</tool_call>" + call(id="c1", name="add", arguments={"a": 1, "b": 1})),
        (2, 0, "assistant", call(id="p", name="add", arguments={"a": "$q", "b": 1}) + call(id="q", name="add", arguments={"a": "$p", "b": 1})),
        (3, 0, None, None),
        (3, 1, "tool", "plain text"),
        (None, None, "user", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("message", F.lit("clash"))
    got = {(r["conv_id"], r["turn"]): r for r in chat.format_messages(df, SCHEMAS).collect()}
    assert len(got) == len(rows)
    assert got[1, 0]["message"] == '{"content":"say \\"hi\\"\\n\u20ac","role":"user"}'
    assert got[1, 1]["message"] == '{"content":"ok","role":"assistant","tool_calls":[{"arguments":{"a":1,"b":2},"id":"c1","name":"add"},{"arguments":{"a":"$c1","b":1},"id":"c2","name":"add"}]}'
    assert (got[1, 1]["n_calls"], got[1, 1]["n_answered"], got[1, 1]["n_invalid"]) == (2, 2, 0)
    assert (got[1, 3]["answers_turn"], got[1, 3]["sort_turn"], got[1, 3]["sort_depth"]) == (1, 1, 2) and got[1, 2]["sort_depth"] == 1
    assert got[1, 3]["message"] == '{"content":"{\\"a\\":[1.5],\\"z\\":1}","role":"tool","tool_call_id":"c2"}'
    assert got[1, 4]["answers_turn"] is None and (got[1, 5]["n_calls"], got[1, 5]["n_answered"], got[1, 5]["n_invalid"]) == (3, 0, 3)
    assert got[2, 0]["n_invalid"] == 2 and got[3, 0]["message"] == '{"content":null,"role":null}' and got[3, 1]["message"] == '{"content":"plain text","role":"tool"}'
    assert chat.format_messages(df.limit(0)).count() == 0


def test_long_chain_of_calls(spark):
    call = lambda **x: f"<tool_call>{json.dumps(x)}</tool_call>"
    n = 36
    rows = [(1, 0, "assistant", "".join(call(id=f"c{i}", name="f", arguments={"a": f"$c{i - 1}"} if i else {}) for i in range(n)) + call(id="p", name="f", arguments={"a": "$p"}))]
    rows += [(1, 1 + i, "tool", json.dumps({"tool_call_id": f"c{i}", "content": "x"})) for i in range(n)] + [(1, 1 + n, "tool", json.dumps({"tool_call_id": "p", "content": "x"}))]
    got = {r["turn"]: r for r in chat.format_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[0]["n_calls"], got[0]["n_answered"], got[0]["n_invalid"]) == (n + 1, n + 1, 1)
    assert [got[1 + i]["sort_depth"] for i in range(n + 1)] == list(range(1, n + 2))


def test_calls_follow_those_they_take(spark):
    call = lambda i, **x: f"<tool_call>{json.dumps({'id': i, 'name': 'f', 'arguments': x})}</tool_call>"
    text = call("z", a="$z") + call("c", a="$b") + call("b", a="$a") + call("d") + call("a") + "<tool_call>{bad</tool_call>"
    (got,) = chat.format_messages(spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")).collect()
    assert [c["id"] for c in json.loads(got["message"])["tool_calls"]] == ["d", "a", "b", "c", "z", None] and got["n_invalid"] == 2


def test_repeated_turns_and_odd_values(spark):
    call = lambda **x: f"<tool_call>{json.dumps(x)}</tool_call>"
    big = "<tool_call>" + '{"id": "n", "name": "add", "arguments": {"a": 1' + "0" * 400 + ', "b": 1}}' + "</tool_call>"
    rows = [(1, 0, "assistant", call(id="a", name="add", arguments={"a": 1, "b": 1}))] * 2 + [(1, 0, "assistant", call(id="a", name="add", arguments={"a": 2, "b": 1}))]
    rows += [(1, 1, "tool", '{"tool_call_id": "a", "content": "\\ud800"}'), (2, 0, "assistant", '<tool_call>{"id": "\\udfff", "name": "add", "arguments": {"a": "\\ud800x", "b": 1}}</tool_call>')]
    rows += [(3, 0, "assistant", big + call(id="n", name="add", arguments={"a": 1, "b": 1})), (4, None, "assistant", call(id="z", name="add", arguments={"a": 1, "b": 1})), (4, 1, "tool", '{"tool_call_id": "z", "content": 1e999}')]
    rows += [(5, 0, "assistant", "word " * 200_000 + call(id="l", name="add", arguments={"a": 1, "b": 1}))]
    got = chat.format_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("row", F.lit("clash")), SCHEMAS).collect()
    of = lambda c, t: sorted((r["n_calls"], r["n_answered"], r["n_invalid"]) for r in got if (r["conv_id"], r["turn"]) == (c, t))
    assert len(got) == len(rows) and of(1, 0) == [(1, 0, 1), (1, 1, 0), (1, 1, 0)]
    (tool,) = (r for r in got if (r["conv_id"], r["turn"]) == (1, 1))
    assert json.loads(tool["message"])["content"] == "\ufffd" and (tool["answers_turn"], tool["sort_depth"]) == (0, 1)
    assert of(2, 0) == [(1, 0, 1)] and of(3, 0) == [(2, 0, 1)] and of(4, None) == [(1, 0, 0)] and of(5, 0) == [(1, 0, 0)]
    assert chat.faults(10**400, {"type": "integer"}) == [] and chat.faults(1.5, {"type": "integer"}) == ["$: not integer"]


def test_traces_of_conversations(spark, tmp_path):
    from chainweave.llm import queries

    rows = [(c, t, ["user", "assistant"][(t + c) % 2] if t or c % 5 else "system", "word " * ((c * 7 + t * 3) % 40) + "end") for c in range(12) for t in range(9) if (c + t) % 11]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op7_chat_format(spark, str(tmp_path)).collect()
    duckdb = pytest.importorskip("duckdb")
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = duckdb.sql(chat.ORACLE)
    assert sorted(want.columns) == sorted(got[0].__fields__)
    assert sorted(map(str, want.select(*got[0].__fields__).fetchall())) == sorted(str(tuple(r)) for r in got)
    assert all(sum(r[n] for r in got) for n in ("n_calls", "n_answered", "n_invalid")) and max(r["sort_depth"] for r in got) > 3


def test_neighbours(spark):
    rnd = np.random.default_rng(5)
    vectors = np.round(rnd.standard_normal((3000, 16)), 3)
    vectors[100:160] = vectors[7]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(5001, None), (5002, [0.0] * 16), (5003, [float("nan")] + [1.0] * 15), (5004, [None] + [1.0] * 15), (5005, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (5006, [1.0, 2.0]), (5020, [2.0, 1.0]), (40, vectors[40].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("shard", F.lit("clash"))
    index = ann.build_index(df, shard=1000)
    found = ann.search(index, df.filter("vec_id % 20 = 0")).cache()
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {*range(0, 3000, 20), 5020} and [x[1:] for x in got[5020]] == [(5006, 4.0)]
    hits = total = 0
    for q in range(0, 3000, 20):
        s = (vectors * vectors[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -s))[:20]
        mine = sorted(got[q])
        assert [k for k, _, _ in mine] == list(range(1, 21)) and all(sc == (vectors[v] * vectors[q]).sum() for _, v, sc in mine)
        assert [(-sc, v) for _, v, sc in mine] == sorted((-sc, v) for _, v, sc in mine)
        hits += len({v for _, v, _ in mine} & set(want.tolist()))
        total += 20
    assert hits / total >= 0.95
    assert {v for _, v, _ in got[100]} <= {*range(101, 160), 7} or vectors[7] @ vectors[7] < max(vectors @ vectors[7])
    assert ann.search(ann.build_index(df.limit(0)), df.limit(0)).count() == 0
