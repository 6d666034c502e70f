"""Key access, ranges and lookups over blocks, transactions and outputs, and the joins that answer them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.registry import register, register_sql
from chainweave.views import Ledger

#: The block, transaction and address that single lookups are shown with.
H, TX, ADDRESS = 120, "(SELECT min(txid) FROM {txs})", 7


def get_many(keys: DataFrame, relation: DataFrame, key: str) -> DataFrame:
    """Batched lookup, aligned to the keys' order (pos); nulls where a key is missing. Keys not seen are null."""
    return keys.join(relation, key, "left").orderBy("pos")


# Point and existence lookups: predicates on a key, pushed to the scan wherever the key is stored.
register_sql("hash_by_height", f"SELECT height, block_hash FROM {{blocks}} WHERE height = {H}")
register_sql("height_by_hash", f"SELECT height, block_hash FROM {{blocks}} WHERE block_hash = sha2(CAST({H} AS STRING), 256)")
register_sql("highest_stored_height", "SELECT min(height) AS height FROM (SELECT height, lead(height) OVER (ORDER BY height) AS nxt FROM {blocks}) t WHERE nxt IS NULL OR nxt - height > 1")
register_sql("header_by_hash", f"SELECT height, block_hash, prev_hash, ts FROM {{blocks}} WHERE block_hash = sha2(CAST({H} AS STRING), 256)")
register_sql("block_metadata", f"SELECT block_hash, n_tx FROM {{blocks}} WHERE block_hash = sha2(CAST({H} AS STRING), 256)")
register_sql("blocks_by_height_range", "SELECT height, block_hash, prev_hash, ts, n_tx FROM {blocks} WHERE height BETWEEN 100 AND 250")
register_sql("block_count", "SELECT count(*) AS n FROM {blocks}")
register_sql("has_block_body", "SELECT b.height, b.block_hash FROM {blocks} b WHERE EXISTS (SELECT 1 FROM {txs} t WHERE t.height = b.height)")
register_sql("best_block", "SELECT max_by(block_hash, height) AS block_hash, max(height) AS height FROM {blocks}")
register_sql("transaction_by_id", f"SELECT txid, height, tx_index, seq, pending FROM {{txs}} WHERE txid = {TX}")
register_sql("tx_metadata", f"SELECT t.txid, b.block_hash, t.height, t.tx_index FROM {{txs}} t JOIN {{blocks}} b ON b.height = t.height WHERE t.txid = {TX}")
register_sql("block_transactions", f"SELECT txid, tx_index FROM {{txs}} WHERE height = {H} ORDER BY tx_index")
register_sql("has_transaction", f"SELECT count(*) > 0 AS found FROM {{txs}} WHERE txid = {TX}")
register_sql("txs_by_height_range", "SELECT txid, height, tx_index FROM {txs} WHERE height BETWEEN 200 AND 300 ORDER BY height, tx_index")
register_sql("txs_by_address", f"SELECT t.txid, t.height, t.tx_index FROM {{txs}} t WHERE EXISTS (SELECT 1 FROM {{tx_outputs}} o WHERE o.txid = t.txid AND o.address = {ADDRESS})")
register_sql("txs_by_value_range", "SELECT t.txid, t.height, t.tx_index FROM {txs} t WHERE EXISTS (SELECT 1 FROM {tx_outputs} o WHERE o.txid = t.txid AND o.value BETWEEN 9000000 AND 9100000)")
register_sql("address_spends", f"SELECT i.txid, i.prev_txid, i.prev_vout, o.value FROM {{tx_inputs}} i JOIN {{tx_outputs}} o ON o.txid = i.prev_txid AND o.vout = i.prev_vout WHERE o.address = {ADDRESS}")
register_sql("utxo_by_outpoint", "SELECT u.txid, u.vout, u.value, u.address, u.height FROM {utxos} u WHERE u.txid = (SELECT min(txid) FROM {utxos}) AND u.vout = 0")
register_sql("has_utxo", "SELECT o.txid, o.vout, u.txid IS NOT NULL AS unspent FROM {tx_outputs} o LEFT JOIN {utxos} u ON u.txid = o.txid AND u.vout = o.vout")
register_sql("is_spent", "SELECT o.txid, o.vout FROM {tx_outputs} o WHERE EXISTS (SELECT 1 FROM {tx_inputs} i WHERE i.prev_txid = o.txid AND i.prev_vout = o.vout)")
register_sql("blocks_with_gap", "SELECT height, nxt FROM (SELECT height, lead(height) OVER (ORDER BY height) AS nxt FROM {blocks} WHERE height % 97 <> 5) t WHERE nxt - height > 1")
register_sql("filter_header_range", "SELECT height, block_hash FROM {blocks} WHERE height >= 700 AND height <= (SELECT height FROM {blocks} WHERE block_hash = sha2('800', 256))")
register_sql("filter_checkpoints", "SELECT height, block_hash FROM {blocks} WHERE height % 1000 = 0")
register_sql("commitments_by_height_range", "SELECT b.height, b.block_hash, count(o.txid) AS outputs, CAST(coalesce(sum(o.value), 0) AS BIGINT) AS amount FROM {blocks} b LEFT JOIN {tx_outputs} o ON o.height = b.height WHERE b.height BETWEEN 10 AND 60 GROUP BY b.height, b.block_hash")
register_sql("kv_len", "SELECT (SELECT count(*) FROM {blocks}) AS blocks, (SELECT count(*) FROM {txs}) AS txs, (SELECT count(*) FROM {utxos}) AS utxos")
register_sql("kv_is_empty", "SELECT count(*) = 0 AS is_empty FROM {tx_inputs} WHERE height < 0")
register_sql("kv_iter", "SELECT txid, vout, value FROM {utxos} ORDER BY txid, vout")
register_sql("disk_size_estimate", "SELECT CAST(least((SELECT count(*) FROM {blocks}) * 1024000 + (SELECT count(*) FROM {utxos}) * 100 + (SELECT count(*) FROM {txs}) * 500, 10000000000000) AS BIGINT) AS bytes")
register_sql("storage_bounds", "SELECT (SELECT count(*) FROM {blocks}) <= 10000000 AND (SELECT count(*) FROM {utxos}) <= 1000000000 AND (SELECT count(*) FROM {txs}) <= 1000000000 AS within")


@register("kv_get_many", "SELECT k.pos, k.height, b.block_hash FROM (SELECT i AS pos, (i * 577) % 5000 AS height FROM range(200) r(i)) k LEFT JOIN blocks b USING (height)")
def _kv_get_many(ledger: Ledger) -> DataFrame:
    keys = ledger.spark.range(200).select(F.col("id").alias("pos"), (F.col("id") * 577 % 5000).alias("height"))
    return get_many(keys, ledger["blocks"].select("height", "block_hash"), "height").select("pos", "height", "block_hash")


@register("kv_contains_key", "SELECT height + 1 AS height, (height + 1) IN (SELECT height FROM blocks) AS found FROM blocks")
def _kv_contains(ledger: Ledger) -> DataFrame:
    """Whether the height after each block's has a block."""
    keys = ledger["blocks"].select((F.col("height") + 1).alias("height"))
    return keys.join(ledger["blocks"].select("height", F.lit(True).alias("found")), "height", "left").select("height", F.coalesce("found", F.lit(False)).alias("found"))


def headers_after(blocks: DataFrame, locator: DataFrame, stop_hash: str, most: int = 2000) -> DataFrame:
    """Headers after the first locator hash (lowest pos) that the chain has, up to stop_hash, at most `most`. No hash of the locator on the chain: none."""
    first = blocks.join(F.broadcast(locator), "block_hash").agg(F.min_by("height", "pos").alias("from"))
    stop = blocks.filter(F.col("block_hash") == stop_hash).agg(F.max("height").alias("to"))
    bounds = first.withColumn("one", F.lit(1)).join(stop.withColumn("one", F.lit(1)), "one")
    near = blocks.join(F.broadcast(bounds.drop("one")), (F.col("height") > F.col("from")) & (F.col("to").isNull() | (F.col("height") <= F.col("to"))) & (F.col("height") <= F.col("from") + most))
    return near.select("height", "block_hash", "prev_hash")


@register("headers_response", "SELECT height, block_hash, prev_hash FROM blocks WHERE height > 640 AND height <= 700")
def _headers(ledger: Ledger) -> DataFrame:
    """A locator whose first two hashes are unknown."""
    spark = ledger.spark
    locator = spark.createDataFrame([(0, "00"), (1, "ff")], "pos int, block_hash string").unionByName(spark.createDataFrame([(2, 640), (3, 600)], "pos int, h int").select("pos", F.sha2(F.col("h").cast("string"), 256).alias("block_hash")))
    import hashlib

    return headers_after(ledger["blocks"], locator, hashlib.sha256(b"700").hexdigest())


@register(
    "block_verbose",
    f"""SELECT b.height, b.block_hash, b.prev_hash, b.ts, b.n_tx, n.block_hash AS next_hash, (SELECT max(height) FROM blocks) - b.height + 1 AS confirmations, l.ids AS txids
    FROM blocks b LEFT JOIN blocks n ON n.height = b.height + 1 JOIN (SELECT height, string_agg(txid, ',' ORDER BY tx_index) AS ids FROM txs GROUP BY height) l ON l.height = b.height WHERE b.height = {H}""",
)
def _block_verbose(ledger: Ledger) -> DataFrame:
    """A block with its transactions in order; tips, next and nested rows are joined from pruned columns."""
    blocks = ledger["blocks"]
    one = blocks.filter(F.col("height") == H)
    tip = blocks.agg(F.max("height").alias("tip"))
    ids = ledger["txs"].filter(F.col("height") == H).groupBy("height").agg(F.array_sort(F.collect_list(F.struct("tx_index", "txid"))).alias("t"))
    nxt = blocks.select((F.col("height") - 1).alias("height"), F.col("block_hash").alias("next_hash"))
    rows = one.join(ids, "height").join(nxt, "height", "left").join(F.broadcast(tip))
    return rows.select("height", "block_hash", "prev_hash", "ts", "n_tx", "next_hash", F.greatest(F.col("tip") - F.col("height") + 1, F.lit(0)).alias("confirmations"), F.array_join("t.txid", ",").alias("txids"))


register_sql(
    "block_headers_verbose",
    "SELECT b.height, b.block_hash, b.prev_hash, b.ts, lead(b.block_hash) OVER (ORDER BY b.height) AS next_hash, (SELECT max(height) FROM {blocks}) - b.height + 1 AS confirmations FROM {blocks} b",
)
register_sql(
    "transaction_details",
    "SELECT txid, state, height, n_in, n_out, fee FROM (SELECT f.txid, CASE WHEN f.pending THEN 'pool' ELSE 'chain' END AS state, CASE WHEN f.pending THEN NULL ELSE f.height END AS height, f.n_in, f.n_out, f.fee, row_number() OVER (PARTITION BY f.txid ORDER BY CASE WHEN f.pending THEN 0 ELSE 1 END) AS r FROM {tx_fees} f) t WHERE r = 1",
)
register_sql(
    "gettxout",
    "SELECT txid, vout, value, address, CASE WHEN pending THEN 0 ELSE (SELECT max(height) FROM {txs} WHERE NOT pending) - height + 1 END AS confirmations FROM {tx_outputs} o WHERE NOT EXISTS (SELECT 1 FROM {tx_inputs} i WHERE i.prev_txid = o.txid AND i.prev_vout = o.vout) AND o.value > 10000000",
)
register_sql(
    "raw_transactions",
    "SELECT t.txid, t.height, b.block_hash, b.ts, CAST((SELECT max(height) FROM {blocks}) - t.height + 1 AS BIGINT) AS confirmations FROM {txs} t LEFT JOIN {blocks} b ON b.height = t.height WHERE t.height BETWEEN 400 AND 420",
)

# Lookup joins.
register_sql("tx_fees", "SELECT txid, n_in, n_out, value_in, value_out, fee, vsize, fee_rate FROM {tx_fees}")
register_sql("block_filter_scripts", "SELECT DISTINCT i.height, o.address FROM {tx_inputs} i JOIN {tx_outputs} o ON o.txid = i.prev_txid AND o.vout = i.prev_vout")
register_sql(
    "address_info",
    "SELECT o.address, count(*) AS n_outputs, CAST(sum(o.value) AS BIGINT) AS received, CAST(sum(CASE WHEN u.txid IS NOT NULL THEN o.value ELSE 0 END) AS BIGINT) AS balance, CAST(sum(CASE WHEN u.txid IS NULL THEN o.value ELSE 0 END) AS BIGINT) AS sent FROM {tx_outputs} o LEFT JOIN {utxos} u ON u.txid = o.txid AND u.vout = o.vout GROUP BY o.address",
)
register_sql("external_inputs", "SELECT i.height, i.prev_txid, i.prev_vout FROM {tx_inputs} i WHERE NOT EXISTS (SELECT 1 FROM {txs} t WHERE t.height = i.height AND t.txid = i.prev_txid)")
register_sql("prefetch_utxo_map", "SELECT i.txid, i.prev_txid, i.prev_vout, o.value, o.address FROM {tx_inputs} i LEFT JOIN {tx_outputs} o ON o.txid = i.prev_txid AND o.vout = i.prev_vout WHERE i.height = 200")
register_sql(
    "supplement_utxo_map",
    "SELECT prev_txid, prev_vout, value, 'cache' AS origin FROM (SELECT i.prev_txid, i.prev_vout, o.value, o.height FROM {tx_inputs} i JOIN {tx_outputs} o ON o.txid = i.prev_txid AND o.vout = i.prev_vout WHERE i.height BETWEEN 200 AND 210) a WHERE a.height >= 200 UNION ALL SELECT prev_txid, prev_vout, value, 'disk' AS origin FROM (SELECT i.prev_txid, i.prev_vout, o.value, o.height FROM {tx_inputs} i JOIN {tx_outputs} o ON o.txid = i.prev_txid AND o.vout = i.prev_vout WHERE i.height BETWEEN 200 AND 210) b WHERE b.height < 200",
)
