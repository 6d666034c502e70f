"""Set operations: inventories, reconciliation, package rules and order-independent digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainweave.functions.filters import block_filters
from chainweave.functions.hashing import short_tx_id
from chainweave.registry import register, register_sql
from chainweave.views import Ledger

#: Items that one peer's inventory and all inventories hold at most; the newest stay.
PEER_CAP, GLOBAL_CAP = 50_000, 250_000


def add_inventory(known: DataFrame, new: DataFrame, peer_cap: int = PEER_CAP) -> DataFrame:
    """(peer, item, sec): union without repeats, the newest peer_cap of each peer."""
    both = known.unionByName(new).groupBy("peer", "item").agg(F.max("sec").alias("sec"))
    place = F.row_number().over(Window.partitionBy("peer").orderBy(F.desc("sec"), "item"))
    return both.withColumn("place", place).filter(F.col("place") <= peer_cap).drop("place")


@register("inventory_union", "SELECT peer, item, sec FROM (SELECT peer, item, max(sec) AS sec, row_number() OVER (PARTITION BY peer ORDER BY max(sec) DESC, item) AS r FROM (SELECT peer, event_id // 3 AS item, sec FROM peer_samples) x GROUP BY peer, item) t WHERE r <= 20")
def _inventory(ledger: Ledger) -> DataFrame:
    items = ledger["peer_samples"].select("peer", F.expr("event_id div 3").alias("item"), "sec")
    return add_inventory(items.filter("item % 2 = 0"), items.filter("item % 2 = 1"), 20)


register_sql("inventory_of_peer", "SELECT DISTINCT event_id div 3 AS item FROM {peer_samples} WHERE peer = 7")
register_sql("has_inventory", "SELECT count(*) > 0 AS found FROM {peer_samples} WHERE event_id div 3 = 100")
register_sql("stale_requests", "SELECT event_id, sec FROM {peer_samples} WHERE (SELECT max(sec) FROM {peer_samples}) - sec >= 86400 * 25")


@register("reconciled_difference", "SELECT DISTINCT event_id // 5 AS item FROM peer_samples WHERE peer = 3 AND event_id // 5 NOT IN (SELECT event_id // 5 FROM peer_samples WHERE peer = 4)")
def _difference(ledger: Ledger) -> DataFrame:
    """What the remote side has and we lack, exact instead of by a sketch."""
    items = lambda p: ledger["peer_samples"].filter(F.col("peer") == p).select(F.expr("event_id div 5").alias("item")).distinct()
    return items(3).exceptAll(items(4))


register_sql("symmetric_difference", "SELECT item, CAST(max(side) AS BIGINT) AS side FROM (SELECT DISTINCT event_id div 7 AS item, 1 AS side FROM {peer_samples} WHERE peer = 3 UNION ALL SELECT DISTINCT event_id div 7 AS item, 2 AS side FROM {peer_samples} WHERE peer = 4) t GROUP BY item HAVING count(*) = 1")
register_sql("double_spends", "SELECT prev_txid, prev_vout, count(*) AS n FROM {tx_inputs} GROUP BY prev_txid, prev_vout HAVING count(*) > 1")
register_sql("package_misordered", "SELECT e.parent, e.child FROM {pool_edges} e JOIN {mempool} p ON p.txid = e.parent JOIN {mempool} c ON c.txid = e.child WHERE p.added_seq >= c.added_seq")
register_sql(
    "package_verdicts",
    "SELECT package, n, weight, CASE WHEN n > 25 THEN 'too many' WHEN weight > 20000 THEN 'too heavy' WHEN fees > 0 AND fees * 4 < 1000 * weight THEN 'low rate' ELSE 'ok' END AS verdict FROM (SELECT CAST(added_seq div 30 AS BIGINT) AS package, count(*) AS n, CAST(sum(68 * n_in + 31 * n_out + 10) AS BIGINT) AS weight, CAST(sum(fee) AS BIGINT) AS fees FROM {mempool} GROUP BY added_seq div 30) t",
)
#: Nonce of the compact blocks below; ids are SipHash under it and its successor.
NONCE = 7


@register("compact_block_split")
def _compact(ledger: Ledger) -> DataFrame:
    """Block 150 as a compact block: the first transaction in full, six bytes of the others."""
    t = ledger["txs"].filter("height = 150").select("height", "tx_index", "txid", short_tx_id(NONCE)("txid").alias("id"))
    return t.select("height", "tx_index", "txid", F.when(F.col("tx_index") == 0, "prefilled").otherwise("short").alias("kind"), F.when(F.col("tx_index") > 0, F.col("id")).alias("short_id"))


@register("compact_block_missing", "SELECT height, tx_index, txid FROM txs WHERE height BETWEEN 150 AND 160 AND seq % 3 = 0")
def _missing(ledger: Ledger) -> DataFrame:
    """Transactions of the blocks whose short ids no known transaction has; two in three are known."""
    ids = ledger["txs"].withColumn("id", short_tx_id(NONCE)("txid"))
    return ids.filter("height BETWEEN 150 AND 160").join(ids.filter("seq % 3 <> 0").select("id"), "id", "left_anti").select("height", "tx_index", "txid")


@register("block_filters")
def _filters(ledger: Ledger) -> DataFrame:
    """Filter of every block: scripts of what it pays and of what it spends, addresses standing for scripts."""
    outputs = ledger["tx_outputs"]
    spent = ledger["tx_inputs"].select("height", F.col("prev_txid").alias("txid"), F.col("prev_vout").alias("vout")).join(outputs.select("txid", "vout", "address"), ["txid", "vout"])
    # Equal scripts of a block meet before its hash is joined and its set is built.
    pairs = outputs.select("height", "address").unionByName(spent.select("height", "address")).distinct()
    named = ledger["blocks"].select("height", "block_hash").join(pairs, "height", "left")
    return block_filters(named.select("height", "block_hash", F.encode(F.col("address").cast("string"), "UTF-8").alias("script")))


@register("block_filter_sizes", "SELECT b.height, count(DISTINCT s.address) AS n_items FROM blocks b LEFT JOIN (SELECT height, address FROM tx_outputs UNION ALL SELECT i.height, o.address FROM tx_inputs i JOIN tx_outputs o ON o.txid = i.prev_txid AND o.vout = i.prev_vout) s ON s.height = b.height GROUP BY b.height")
def _filter_sizes(ledger: Ledger) -> DataFrame:
    """How many items the filters hold, as their first bytes say."""
    return _filters(ledger).select("height", "n_items")


register_sql("denylist_merged", "SELECT block_hash FROM {blocks} WHERE height < 20 UNION SELECT block_hash FROM {blocks} WHERE height BETWEEN 10 AND 30")


def set_digest(rows: DataFrame, *columns: str) -> DataFrame:
    """Order-independent digest of a set: the sum of 60 bits of each row's SHA-256, modulo 2 ** 64. Added and removed rows change it by their own sums, partial sums do."""
    row = F.conv(F.substring(F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in columns]), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.pmod(F.sum(row), F.lit("18446744073709551616").cast("decimal(38,0)")).cast("string").alias("digest"), F.count(F.lit(1)).alias("n"))


@register("utxo_set_digest", "SELECT (sum(('0x' || substr(sha256(concat_ws(':', txid, vout::VARCHAR, value::VARCHAR)), 1, 15))::BIGINT) % 18446744073709551616::HUGEINT)::VARCHAR AS digest, count(*) AS n FROM utxos")
def _digest(ledger: Ledger) -> DataFrame:
    return set_digest(ledger["utxos"], "txid", "vout", "value")


@register("ban_list_hash", "SELECT sha256(string_agg(x, ';' ORDER BY x)) AS digest FROM (SELECT peer::VARCHAR || ':' || max(sec)::VARCHAR AS x FROM peer_samples WHERE kind = 'error' GROUP BY peer) t")
def _ban_hash(ledger: Ledger) -> DataFrame:
    """A digest of a sorted list; the list is as long as the ban list."""
    bans = ledger["peer_samples"].filter("kind = 'error'").groupBy("peer").agg(F.max("sec").alias("until")).select(F.concat_ws(":", F.col("peer").cast("string"), F.col("until").cast("string")).alias("x"))
    return bans.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("x")), ";"), 256).alias("digest"))
