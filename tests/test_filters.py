"""Block filters, short ids, work and index records against published values and plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_wire import FIRST

from chainweave.functions import filters, hashing, wire
from chainweave.operators import graph, payments, records, relay
from chainweave.registry import queries

TABLES = "/root/testdata/sf0.001"


def test_hashes_of_many():
    key = bytes(range(16))
    k0, k1 = (int.from_bytes(key[i : i + 8], "little") for i in (0, 8))
    assert hashing.siphash24(k0, k1, bytes(range(15))) == 0xA129CA6149BE45E5
    rnd = random.Random(1)
    data = [rnd.randbytes(rnd.randint(0, 40)) for _ in range(300)] + [b"", bytes(1000)]
    keys = np.array([rnd.getrandbits(64) for _ in data], np.uint64), np.array([rnd.getrandbits(64) for _ in data], np.uint64)
    assert filters.siphash_many(*keys, data).tolist() == [hashing.siphash24(int(a), int(b), d) for a, b, d in zip(*keys, data, strict=True)]


def test_published_filter():
    """The first block of the public test network, as the filter's specification gives it."""
    script = wire.decode_transaction(FIRST)["outputs"][0]["script_pubkey"]
    block = "000000000933ea01ad0ee984209779baaec3ced90fa3f408719526f8d77f4943"
    data = filters.encode_filter(block, [script, script, b""])
    assert data.hex() == "019dfca8" and filters.filter_header(data, "00" * 32) == "21584579b7eb08997773e5aeff3a7f932700042d0ed2a6129012b7d7ae81b750"
    assert filters.matches(block, data, [script]) and not filters.matches(block, data, [b"other"]) and not filters.matches(block, data, [])
    assert filters.encode_filter(block, []) == b"\0" and not filters.matches(block, b"\0", [script])
    with pytest.raises(ValueError):
        filters.decode_filter(data[:2])


def test_filters_hold_their_scripts():
    rnd = random.Random(4)
    for n in (1, 2, 50, 1000):
        block, items = rnd.randbytes(32).hex(), [rnd.randbytes(rnd.randint(1, 60)) for _ in range(n)]
        data = filters.encode_filter(block, items)
        assert filters.decode_filter(data)[0] == n and all(filters.matches(block, data, [i]) for i in items[:20])
        assert sum(filters.matches(block, data, [rnd.randbytes(20)]) for _ in range(50)) <= 1


def test_filter_rows(spark):
    rows = [(0, "00" * 32, b"a"), (0, "00" * 32, b"a"), (0, "00" * 32, None), (1, "11" * 32, b""), (1, "11" * 32, None)]
    made = {r["height"]: r for r in filters.block_filters(spark.createDataFrame(rows, "height long, block_hash string, script binary")).collect()}
    assert made[0]["filter"] == filters.encode_filter("00" * 32, [b"a"]).hex() and (made[1]["n_items"], made[1]["filter"]) == (0, "00")
    assert filters.block_filters(spark.createDataFrame([], "height long, block_hash string, script binary")).count() == 0
    found = queries()["block_filters"](spark, TABLES)
    paid = queries()["address_received"](spark, TABLES).first()["address"]
    assert any(filters.matches(hashing.hashlib.sha256(str(r["height"]).encode()).hexdigest(), bytes.fromhex(r["filter"]), [str(paid).encode()]) for r in found.collect())


def test_short_ids(spark):
    rows = queries()["compact_block_split"](spark, TABLES).collect()
    assert rows
    for r in rows:
        whole = hashing.siphash24(7, 8, bytes.fromhex(r["txid"]))
        assert r["short_id"] == (whole.to_bytes(8, "little")[:6].hex() if r["tx_index"] else None)


def test_work_and_difficulty(spark):
    bits = [0x1D00FFFF, 0x1B0404CB, 0x170E2632, 0x207FFFFF, 0x1D000000]
    rows = spark.createDataFrame([(b,) for b in bits], "bits long").select("bits", hashing.block_work(F.col("bits")).alias("w"), hashing.difficulty(F.col("bits")).alias("d"), hashing.chainwork_hex(hashing.block_work(F.col("bits"))).alias("h")).collect()
    for r in rows:
        assert int(r["w"]) == hashing.work_of_bits(r["bits"]) == int(r["h"], 16) and len(r["h"]) == 64 and r["d"] == pytest.approx(hashing.difficulty_of_bits(r["bits"]))
    assert wire.simplified_work(0x1D00FFFF) == 1 and rows[1]["d"] == pytest.approx(16307.420938523983)


def test_index_records(spark):
    values = {"height": 5, "status": 29, "n_tx": 2**32 - 1, "n_file": 0, "data_pos": 7, "undo_pos": 8, "version": 4, "prev_hash": "ab" * 31 + "01", "merkle_root": "cd" * 32, "time": 1231006505, "bits": 0x1D00FFFF, "nonce": 1}
    plain = b"".join(bytes.fromhex(v)[::-1] if isinstance(v, str) else v.to_bytes(4, "little") for v in values.values())
    one = spark.range(1).select(records.encode_block_index(**{k: F.lit(v) for k, v in values.items()}).alias("data")).first()["data"]
    assert bytes(one) == plain and len(plain) == records.INDEX_BYTES
    read = spark.createDataFrame([(plain,), (plain + b"more",), (plain[:-1],), (b"",), (None,)], "data binary").select(records.parse_block_index(F.col("data")).alias("r")).collect()
    assert [r["r"] and r["r"].asDict() for r in read] == [values, values, None, None, None]
    keys = spark.createDataFrame([(b"b\x00\xff",), (b"B",), (b"\xff1",), (b"",), (None,)], "key binary").select(records.key_kind(F.col("key")).alias("k"), records.convert_key(F.col("key")).alias("v")).collect()
    assert [(r["k"], r["v"] and bytes(r["v"])) for r in keys] == [("block index", b"\x00\xff"), ("best block", bytearray()), ("unknown", b"1"), (None, None), (None, None)]


def test_closures_within_policy(spark):
    edges = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(6)] + [("u", "t1"), ("u", "t1")], "parent string, child string")
    found = {(r["node"], r["ancestor"]) for r in graph.within_policy(edges, 4).collect()}
    assert found == {("t1", "t0"), ("t1", "u"), ("t2", "t0"), ("t2", "t1"), ("t2", "u"), ("t3", "t0"), ("t3", "t1"), ("t3", "t2"), ("t3", "u")}
    assert graph.within_policy(edges.limit(0), 4).count() == 0


def test_pruned_parts_and_stems(spark):
    blocks = spark.range(20).select(F.col("id").alias("height"))
    parts = payments.prune_components(blocks, 8, 5, keep_headers=False).filter("NOT has_header").agg(F.max("height"), F.bool_or("has_body"), F.bool_or("has_witness"), F.bool_and("has_commitment")).first()
    assert tuple(parts) == (4, False, False, True)
    most = payments.prune_aggressively(blocks, 18, 1, keep_filtered=True, recent=3).filter("NOT has_body").agg(F.max("height"), F.bool_and("has_witness"), F.bool_or("has_filter")).first()
    assert tuple(most) == (15, True, False)
    states = spark.createDataFrame([(1, "a", 0, 0), (2, "a", 95, 2), (3, "b", 95, 1), (4, "b", 81, 0)], "tx long, peer string, stem_start long, hops long")
    kept = {r["tx"]: (r["reason"], r["expired"]) for r in relay.stem_decisions(states, F.lit(100), share=0.0).collect()}
    assert kept == {1: ("timeout", True), 2: ("hops", False), 3: (None, False), 4: ("timeout", False)}
    assert relay.stem_decisions(states, F.lit(100), share=1.0).filter("reason IS NULL").count() == 0
