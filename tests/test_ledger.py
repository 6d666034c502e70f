"""Ledger operators: registered queries against their SQL, and scenarios on hand-made relations."""

import glob
import hashlib
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from chainweave import registry
from chainweave.functions import hashing, muhash
from chainweave.operators import graph, network, ordered, payments, pool, sets, temporal
from chainweave.plans import catalogue
from chainweave.sources import snapshot

DATA = "/root/testdata/sf0.001"
SOME = [
    "block_stats", "tx_fees", "address_info", "utxo_live_at_height", "utxo_lookup_latest", "ops_compacted", "median_time_past", "block_template", "evict_hybrid", "ancestor_limits", "chain_tips", "invalidated_blocks", "peer_scores",
    "merged_bans", "usable_addresses", "replacement_verdicts", "mempool_admission", "utxo_set_digest", "value_index", "commitments_every_144", "peer_latency_ema", "payment_states", "stream_window_counts", "stream_deduplicated", "stream_in_order", "kv_get_many", "utxo_with_pending_writes", "block_from_either_source", "package_ids", "active_rules", "connection_limiter", "bandwidth_reset_windows", "stream_connection_limiter", "merkle_roots", "hashrate_by_height", "linkage_check", "same_block_spends", "txoutset_info", "index_stats", "raw_mempool_verbose", "replayed_messages", "latest_metrics",
]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    got = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(str([tidy(r[names.index(c)]) for c in sorted(names)]) for r in got.fetchall())
    assert sorted(str([tidy(r[c]) for c in sorted(names)]) for r in df.collect()) == want


def test_limiter_in_batch_and_stream(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    q = registry.queries()
    batch, stream = (sorted(map(tuple, q[n](spark, DATA).select("key", "at", "id", "accepted").collect())) for n in ("connection_limiter", "stream_connection_limiter"))
    assert batch == stream
    logs, want = {}, []
    for key, at, i, _ in sorted(batch, key=lambda r: (r[0], r[1], r[2])):
        log = [t for t in logs.get(key, []) if t > at - 43200]
        want.append((key, at, i, len(log) < 3))
        logs[key] = [*log, at] if len(log) < 3 else log
    assert sorted(want) == batch


def test_limiter_edges(spark):
    rows = spark.createDataFrame([(1, 0, 0), (1, 5, 1), (1, 9, 2), (1, 10, 3), (1, 14, 4), (2, 3, 5)], "key long, at long, id long")
    got = {r["id"]: r["accepted"] for r in network.sliding_log(rows, 10, 2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: False, 5: True}
    odd = spark.createDataFrame([(None, 1, 0), (None, 1, 0), (None, None, 1), (3, None, 2), (3, 4, 3)], "key long, at long, id long")
    got = sorted((str(r["key"]), str(r["at"]), r["accepted"]) for r in network.sliding_log(odd, 10, 1).collect())
    assert got == [("3", "4", True), ("3", "None", False), ("None", "1", False), ("None", "1", True), ("None", "None", False)]
    assert network.sliding_log(odd.limit(0), 10, 1).count() == 0


def test_reset_windows(spark):
    rows = spark.createDataFrame([(1, 0, 0, 5), (1, 3599, 1, 7), (1, 3600, 2, 1), (1, 9000, 3, 2)], "key long, at long, id long, amount long")
    assert [(r["id"], r["start"], r["used"]) for r in network.reset_windows(rows, 3600).orderBy("id").collect()] == [(0, 0, 5), (1, 0, 12), (2, 3600, 1), (3, 9000, 2)]
    odd = spark.createDataFrame([(None, 5, 0, None), (None, 6, 1, 2), (4, None, 2, 1)], "key long, at long, id long, amount long")
    assert [(r["start"], r["used"]) for r in network.reset_windows(odd, 10).orderBy("id").collect()] == [(5, 0), (5, 2), (None, None)]
    many = spark.range(30_000).selectExpr("id % 2 AS key", "id AS at", "id", "1L AS amount")
    assert {tuple(r) for r in network.reset_windows(many, 10**6).groupBy("key", "start").agg(F.max("used")).collect()} == {(0, 0, 15_000), (1, 1, 15_000)}


def test_as_of_equals_replay(spark):
    rnd = random.Random(1)
    ops, live, states = [], set(), {}
    for h in range(40):
        for _ in range(3):
            k = (f"t{rnd.randint(0, 15)}", rnd.randint(0, 1))
            if k not in live:
                ops.append((*k, h, "A"))
                live.add(k)
                if rnd.random() < 0.3:
                    ops.append((*k, h, "D"))
                    live.discard(k)
            else:
                ops.append((*k, h, "D"))
                live.discard(k)
                break
        states[h] = set(live)
    seen, clean = set(), []
    for o in ops:  # one operation of a kind a height
        if (o[:3], o[3]) not in seen:
            seen.add((o[:3], o[3]))
            clean.append(o)
    df = spark.createDataFrame(clean, "txid string, vout int, height int, op string")
    for h in (0, 13, 39):
        last = {}
        for t, v, at, op in clean:
            if at <= h:
                last[t, v] = max(last.get((t, v), (-1, "")), (at, op))
        assert {(r["txid"], r["vout"]) for r in temporal.live_at(df, h).collect()} == {k for k, (_, op) in last.items() if op == "A"}
    compacted = temporal.compact(df, 20)
    assert compacted.filter("height > 20").count() == df.filter("height > 20").count()
    assert temporal.missing_heights(spark.range(5).select(F.col("id").alias("height")).filter("height <> 3"), 0, 4).first()["height"] == 3
    assert temporal.live_at(df.limit(0)).count() == 0


def test_forks_and_descent(spark):
    rows = [("a0", None, 0)] + [(f"a{i}", f"a{i - 1}", i) for i in range(1, 8)] + [("b5", "a4", 5), ("b6", "b5", 6), ("c5", "a4", 5)]
    blocks = spark.createDataFrame(rows, "block_hash string, prev_hash string, height long")
    assert {(r["block_hash"], r["branch_length"], r["status"]) for r in graph.chain_tips(blocks).collect()} == {("a7", 0, "active"), ("b6", 2, "valid-fork"), ("c5", 1, "valid-fork")}
    marked = spark.createDataFrame([("b5",), ("a6",)], "block_hash string")
    assert {r["block_hash"] for r in graph.pruned_by_descent(blocks, marked).filter("invalid").collect()} == {"b5", "b6", "a6", "a7"}


def test_ancestors(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "d")], "parent string, child string")
    got = {}
    for r in graph.ancestors(edges).collect():
        got.setdefault(r["node"], set()).add(r["ancestor"])
    assert got == {"b": {"a"}, "c": {"a", "b"}, "x": {"a"}, "d": {"a", "b", "c", "x"}}


def test_merkle_roots(spark):
    double = lambda b: hashlib.sha256(hashlib.sha256(b).digest()).digest()
    for n in (1, 2, 3, 5, 8):
        ids = [hashlib.sha256(bytes([i])).hexdigest() for i in range(n)]
        level = [bytes.fromhex(t)[::-1] for t in ids]
        while len(level) > 1:
            level = [double(level[i] + level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
        df = spark.createDataFrame([(7, i, t) for i, t in enumerate(ids)], "height long, tx_index long, txid string")
        assert graph.merkle_levels(df).first()["root"] == level[0][::-1].hex()


def test_template_stops_and_skips(spark):
    pool_rows = [("a", 900, 100, 1), ("b", 800, 200, 2), ("c", 10, 50, 3), ("d", 700, 600, 4), ("e", 600, 10, 5)]
    df = spark.createDataFrame(pool_rows, "txid string, fee_rate long, vsize long, added_seq long")
    assert [r["txid"] for r in ordered.select_template(df, 850, 10_000, 100).orderBy("added_seq").collect()] == ["a", "b"]
    assert [r["txid"] for r in ordered.select_template(df, 910, 10_000, 100).orderBy("added_seq").collect()] == ["a", "b", "d", "e"]


def test_replacement_rules(spark):
    rows = [(1000, 100, 3000, 100, 0, 100), (1000, 100, 1050, 100, 0, 100), (1000, 100, 3000, 100, 0, 5), (1000, 100, 3000, 100, 10, 100), (1000, 100, 1500, 100, 0, 100)]
    df = spark.createDataFrame(rows, "old_fee long, old_size long, new_fee long, new_size long, replaced long, age long")
    assert [r["verdict"] for r in pool.replacement(df, "standard").collect()] == ["replaces", "rate rises too little", "too soon", "too many replacements", "fee rises too little"]
    assert {r["verdict"] for r in pool.replacement(df, "disabled").collect()} == {"replacement is disabled"}


def test_ban_merge_and_digest(spark):
    rows = [("x", 5, "a", 2), ("x", None, "b", 1), ("y", 3, "c", 1), ("y", 9, "d", 2)]
    df = spark.createDataFrame(rows, "addr string, until long, reason string, source long")
    assert {(r["addr"], r["until"], r["reasons"]) for r in network.merge_bans(df).collect()} == {("x", None, "b; a"), ("y", 9, "c; d")}
    assert sets.set_digest(df, "addr", "source").first() == sets.set_digest(df.orderBy(F.desc("source")), "addr", "source").first()


def test_payment_transitions(spark):
    states = spark.createDataFrame([(1, 1, "created"), (1, 2, "settled"), (2, 1, "created"), (3, 1, "failed")], "id long, seq long, state string")
    assert {(r["id"], r["state"]) for r in payments.latest(states).collect()} == {(1, "settled"), (2, "created"), (3, "failed")}
    changes = states.select("id").distinct().withColumn("seq", F.lit(9))
    assert {r["id"] for r in payments.transition(states, changes, "settled").collect()} == {2}
    assert {r["id"] for r in payments.transition(states, changes, "reorg_pending").collect()} == {1}


def test_known_vectors(spark):
    assert hashing.ripemd160(b"").hex() == "9c1185a5c5e9fc54612808977ee8f548b2258d31"
    assert hashing.ripemd160(b"abc").hex() == "8eb208f7e05d987a9b044a8e98c6b087f15a0bfc"
    assert hashing.siphash24(0x0706050403020100, 0x0F0E0D0C0B0A0908, bytes(range(15))) == 0xA129CA6149BE45E5
    assert hashing.segwit_program("BC1QW508D6QEJXTDG4Y5R3ZARVARY0C5XW7KV8F3T4") == ("bc", 0, bytes.fromhex("751e76e8199196d454941c45d1b3a323f1433bd6"))
    assert hashing.segwit_program("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5") is None
    assert hashing.base58check("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa").hex() == "0062e907b15cbf27d5425399ebf6f0fb50ebb88f18"
    assert hashing.work_of_bits(0x1D00FFFF) == 0x100010001 and hashing.difficulty_of_bits(0x1D00FFFF) == 1.0
    row = spark.range(1).select(
        F.hex(hashing.double_sha256(F.lit(b"hello"))).alias("d"), hashing.varint(F.lit(252)).alias("a"), hashing.varint(F.lit(65000)).alias("b"), hashing.varint(F.lit(70000)).alias("c"), hashing.subsidy(F.lit(210000)).alias("s"),
        *[hashing.value_bucket(F.lit(v)).alias(f"v{v}") for v in (0, 1, 9, 10, 999, 1000, 1001)], hashing.parse_payment_uri(F.lit("bitcoin:abc?amount=1.5&label=a%20b")).alias("u"), hashing.hash160(F.lit(b"")).alias("h"),
    ).first()
    assert row["d"].lower() == hashlib.sha256(hashlib.sha256(b"hello").digest()).hexdigest()
    assert (row["a"], row["b"], row["c"], row["s"]) == ("fc", "fde8fd", "fe70110100", 2_500_000_000)
    assert [row[f"v{v}"] for v in (0, 1, 9, 10, 999, 1000, 1001)] == [0, 1000, 1000, 2000, 3000, 4000, 4000]
    assert tuple(row["u"]) == ("abc", 150_000_000, "a b", None) and bytes(row["h"]) == hashing.hash160_bytes(b"")


def test_set_hash(spark):
    rows = [(bytes([i]),) for i in range(6)]
    df = spark.createDataFrame(rows, "b binary")
    whole = muhash.product(df, "b")
    assert whole == muhash.product(df.orderBy(F.desc("b")), "b")
    assert muhash.combine(whole, muhash.element(b"\x05")) == muhash.product(df.filter("b <> X'05'"), "b")


def test_tree_and_checkpoint(spark, tmp_path):
    t = snapshot.Tree(spark, f"{tmp_path}/tree")
    assert t.len() == 0 and t.get(b"a") is None
    t.insert(b"a", b"1")
    t.insert(b"a", b"2")
    t.insert(b"b", b"3")
    t.remove(b"b")
    t.bulk_load_sorted(spark.createDataFrame([(b"d", b"5"), (b"c", b"4")], "key binary, value binary"))
    assert t.get(b"a") == b"2" and not t.contains(b"b")
    t.compact()
    assert [(bytes(r["key"]), bytes(r["value"])) for r in t.iter().collect()] == [(b"a", b"2"), (b"c", b"4"), (b"d", b"5")]
    # A writer that claimed a version and hasn't finished: later batches count, compaction stops before it, and its batch takes its place.
    rows = lambda *kv: spark.createDataFrame(list(kv), "key binary, value binary")
    slow = t.claim()
    t.insert(b"a", b"7")
    t.compact()
    assert t.get(b"a") == b"7" and t.len() == 3
    t._write(rows((b"a", b"6"), (b"e", b"8")), slow)
    assert t.get(b"a") == b"7" and t.get(b"e") == b"8"
    t.compact()
    t.compact()
    t.commit(rows((b"f", b"1"), (b"f", b"2"), (b"f", None)))
    assert t.get(b"f") == b"2" and t.len() == 5 and len(list((tmp_path / "tree").glob("base-*"))) == 2
    # A claim whose writer is gone.
    t.claim()
    t.insert(b"g", b"1")
    t.abandon()
    t.compact()
    assert t.len() == 6
    t.clear()
    assert t.len() == 0
    base = f"{tmp_path}/cp"
    assert snapshot.read_checkpoint(spark, base) is None
    for h in (1, 2, 3):
        snapshot.write_checkpoint(spark.range(h), base, h)
    assert snapshot.read_checkpoint(spark, base).count() == 3 and snapshot.read_pointer(spark, base)["slot"] == 0


def test_snapshots_and_flat_files(spark, tmp_path):
    import struct

    entries = [(bytes([i]) * 32, i, 100 * i, 7, i == 1, b"s" * i) for i in range(4)]
    (tmp_path / "snap").mkdir()
    (tmp_path / "snap" / "a.dat").write_bytes(snapshot.encode_snapshot(b"\x09" * 32, 12, entries))
    got = snapshot.read_snapshots(spark.read.format("binaryFile").load(f"{tmp_path}/snap")).orderBy("vout").collect()
    assert [(bytes.fromhex(r["txid"]), r["vout"], r["value"], r["height"], r["coinbase"], bytes(r["script"])) for r in got] == entries and got[0]["snapshot_height"] == 12
    many = [(bytes([i % 256, i // 256]) * 16, i, i, 7, False, b"") for i in range(30_000)]
    (tmp_path / "snap" / "a.dat").write_bytes(snapshot.encode_snapshot(b"\x09" * 32, 12, many))
    assert snapshot.read_snapshots(spark.read.format("binaryFile").load(f"{tmp_path}/snap")).agg(F.count("*"), F.sum("value")).first()[:] == (30_000, sum(range(30_000)))
    (tmp_path / "snap" / "a.dat").write_bytes(snapshot.encode_snapshot(b"\x09" * 32, 12, many)[:-1])
    with pytest.raises(Exception, match="ends within an entry"):
        snapshot.read_snapshots(spark.read.format("binaryFile").load(f"{tmp_path}/snap")).count()
    head = struct.pack("<i32s32sIII", 1, b"\0" * 32, b"\1" * 32, 1231006505, 0x1D00FFFF, 2083236893)
    (tmp_path / "flat").mkdir()
    magic = bytes.fromhex("f9beb4d9")
    (tmp_path / "flat" / "blk0.dat").write_bytes((magic + struct.pack("<I", 100) + head + b"\2" * 20) * 2 + b"\0" * 50)
    rows = snapshot.read_flat_blocks(spark.read.format("binaryFile").load(f"{tmp_path}/flat")).collect()
    assert [r["offset"] for r in rows] == [8, 116] and rows[0]["block_hash"] == hashlib.sha256(hashlib.sha256(head).digest()).digest()[::-1].hex()


def test_metrics_text(spark):
    rows = [("n_blocks", "gauge", {}, 5.0), ("reads", "counter", {"b": 'x"y', "a": "1"}, 2.0), ("reads", "counter", {"a": "2"}, 3.0)]
    df = spark.createDataFrame(rows, "name string, kind string, labels map<string,string>, value double")
    text = "\n".join(r["value"] for r in snapshot.prometheus_text(df).collect())
    assert text == '# TYPE n_blocks gauge\nn_blocks 5.0\n# TYPE reads counter\nreads{a="1",b="x\\"y"} 2.0\nreads{a="2"} 3.0'


def test_catalogue_names_queries():
    found = registry.queries()
    unknown = {q for names in catalogue.METHODS.values() for q in names if "." not in q and q not in found}
    assert not unknown and not set(catalogue.METHODS) & set(catalogue.OUTSIDE) and set(catalogue.ROUTES.values()) <= set(catalogue.METHODS)


def test_settlements_in_a_stream(spark, tmp_path):
    from chainweave.streaming import operators as streaming

    t = "timestamp'2024-01-01 00:00:00'"
    spark.sql(f"SELECT 1L AS payment, 'a' AS txid, {t} AS asked UNION ALL SELECT 2L, 'b', {t} UNION ALL SELECT 3L, 'zz', {t} + INTERVAL 10 DAYS").write.parquet(f"{tmp_path}/p")
    spark.sql(f"SELECT 'a' AS txid, {t} + INTERVAL 2 HOURS AS seen UNION ALL SELECT 'b', {t} + INTERVAL 30 HOURS UNION ALL SELECT 'q', {t} + INTERVAL 10 DAYS").write.parquet(f"{tmp_path}/c")
    streams = [spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{n}").schema).parquet(f"{tmp_path}/{n}") for n in "pc"]
    rows = streaming.run_available(streaming.settlements(*streams), "append", "settle").collect()
    assert {r["payment"] for r in rows if r["seen"] is not None} == {1} and {r["payment"] for r in rows if r["seen"] is None} <= {2}


def test_extensions(spark):
    from chainweave.plans.extension import Extensions

    e = Extensions()
    e.register("getextra", "m", lambda ledger, p: p["x"])
    e.override("getblockcount", "m", lambda ledger, p: 7)
    assert e.call(None, "getextra", {"x": 3}) == 3 and e.call(None, "getblockcount") == 7
    with pytest.raises(ValueError):
        e.register("getblock", "m", None)
    with pytest.raises(ValueError):
        e.override("getextra", "m", None)
    with pytest.raises(ValueError):
        e.register("getextra", "other", None)
    assert e.unregister_module("m") == 2


def test_small_functions(spark):
    row = spark.range(1).select(hashing.subnet6(F.lit("2001:db8::1")).alias("a"), hashing.subnet6(F.lit("x")).alias("b"), hashing.chainwork_hex(F.lit(255)).alias("c"), hashing.decode_hash32(F.lit("00")).alias("d"), network.is_local(F.lit("172.20.1.1")).alias("e"), network.is_local(F.lit("172.32.1.1")).alias("f")).first()
    assert row["a"] == "2001:0db8:0000:0000" and row["b"] is None and row["c"] == "0" * 62 + "ff" and row["d"] is None and row["e"] and not row["f"]


def test_methods_name_what_exists():
    import importlib

    from chainweave import registry

    for names in catalogue.METHODS.values():
        for name in names:
            if "." in name:
                module, _, entry = name.rpartition(".")
                assert hasattr(importlib.import_module(f"chainweave.{module}"), entry), name
            else:
                assert name in registry.queries(), name
    assert set(catalogue.ROUTES.values()) <= set(catalogue.METHODS)
