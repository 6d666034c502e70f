"""Aggregates over the ledger: chain, set, address, pool and peer statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.functions.hashing import block_work, difficulty
from chainweave.registry import register, register_sql
from chainweave.views import Ledger

#: Base units that the first blocks mint, and blocks between halvings.
SUBSIDY, HALVING = 5_000_000_000, 210_000


def subsidy(height: str) -> str:
    """SQL for a block's subsidy: halved every HALVING blocks, none after 64 halvings."""
    return f"CASE WHEN {height} div {HALVING} >= 64 THEN 0 ELSE CAST(floor({SUBSIDY} / power(2, {height} div {HALVING})) AS BIGINT) END"


register_sql(
    "block_stats",
    f"""SELECT b.height, b.block_hash, b.ts, b.n_tx, CAST(coalesce(f.ins, 0) AS BIGINT) AS ins, CAST(coalesce(f.outs, 0) AS BIGINT) AS outs, CAST(coalesce(f.total_out, 0) AS BIGINT) AS total_out,
    CAST(coalesce(f.total_fee, 0) AS BIGINT) AS total_fee, CAST(coalesce(f.size, 0) AS BIGINT) AS size, f.min_fee, f.max_fee, f.min_fee_rate, f.max_fee_rate, {subsidy('b.height')} AS subsidy
    FROM {{blocks}} b LEFT JOIN (SELECT height, sum(n_in) AS ins, sum(n_out) AS outs, sum(value_out) AS total_out, sum(fee) AS total_fee, sum(vsize) AS size, min(fee) AS min_fee, max(fee) AS max_fee, min(fee_rate) AS min_fee_rate, max(fee_rate) AS max_fee_rate FROM {{tx_fees}} GROUP BY height) f ON f.height = b.height""",
)
register_sql("utxo_count", "SELECT count(*) AS n FROM {utxos}")
register_sql("utxo_total_value", "SELECT CAST(sum(value) AS BIGINT) AS total FROM {utxos}")
register_sql(
    "txoutset_info",
    "SELECT (SELECT max(height) FROM {blocks}) AS height, count(*) AS txouts, count(DISTINCT u.txid) AS transactions, CAST(sum(u.value) AS BIGINT) AS total_amount, 180 * count(*) AS bogosize, count(DISTINCT u.address) AS addresses FROM {utxos} u",
)
register_sql(
    "chain_tx_stats",
    "SELECT count(*) AS window_blocks, CAST(sum(n_tx) AS BIGINT) AS window_txs, max(ts) - min(ts) AS window_seconds, round(CAST(sum(n_tx) AS DOUBLE) / greatest(max(ts) - min(ts), 1), 9) AS tx_rate, (SELECT CAST(sum(n_tx) AS BIGINT) FROM {blocks}) AS txcount FROM {blocks} WHERE height > (SELECT max(height) FROM {blocks}) - 144",
)


@register(
    "network_hashrate",
    "SELECT round((SELECT 65535.0::DOUBLE / (bits % 16777216) FROM blocks ORDER BY height DESC LIMIT 1) * 4294967296.0 / ((max(ts) - min(ts))::DOUBLE / (count(*) - 1)), 3) AS hashrate, count(*) AS blocks FROM (SELECT ts FROM blocks ORDER BY height DESC LIMIT 144)",
)
def _hashrate(ledger: Ledger) -> DataFrame:
    """The tip's difficulty by the mean time between the last 144 blocks; 0 for fewer than two blocks or no time between them."""
    last = ledger["blocks"].orderBy(F.desc("height")).limit(144)
    found = last.agg(F.max_by("bits", "height").alias("bits"), (F.max("ts") - F.min("ts")).cast("double").alias("span"), F.count(F.lit(1)).alias("blocks"))
    rate = difficulty(F.col("bits")) * 4294967296.0 / (F.col("span") / (F.col("blocks") - 1))
    return found.select(F.when((F.col("blocks") < 2) | (F.col("span") <= 0), F.lit(0.0)).otherwise(F.round(rate, 3)).alias("hashrate"), "blocks")


@register("total_work", "SELECT count(*) AS work_simplified, sum((281474976710656 - 1) // (bits % 16777216))::VARCHAR AS work FROM blocks")
def _total_work(ledger: Ledger) -> DataFrame:
    """Work of the whole chain: exact, and by the simplified rule, under which any target above 64 bits counts as 1."""
    size, word = F.expr("bits div 16777216"), F.expr("bits % 16777216")
    small = F.pow(F.lit(2.0), 64) / (F.when(size <= 3, F.floor(word / F.pow(F.lit(256.0), 3 - size))).otherwise(word * F.pow(F.lit(256.0), size - 3)) + 1)
    simplified = F.when(size >= 11, F.lit(1).cast("decimal(20,0)")).otherwise(F.greatest(F.floor(small).cast("decimal(20,0)"), F.lit(1).cast("decimal(20,0)")))
    return ledger["blocks"].agg(F.sum(simplified).cast("long").alias("work_simplified"), F.sum(block_work(F.col("bits"))).cast("decimal(38,0)").cast("string").alias("work"))


register_sql("address_received", "SELECT address, CAST(sum(value) AS BIGINT) AS received FROM {tx_outputs} GROUP BY address")
register_sql("address_index", "SELECT address, count(DISTINCT txid) AS n_txs, count(*) AS n_outputs, min(txid) AS first_txid, max(txid) AS last_txid FROM {tx_outputs} GROUP BY address")
register_sql(
    "value_index",
    "SELECT bucket, count(*) AS n_outputs, count(DISTINCT txid) AS n_txs FROM (SELECT txid, CASE WHEN value = 0 THEN 0 ELSE CAST(length(CAST(value AS STRING)) * 1000 AS BIGINT) END AS bucket FROM {tx_outputs}) t GROUP BY bucket",
)
register_sql(
    "index_stats",
    "SELECT (SELECT count(*) FROM {txs}) AS n_txs, (SELECT count(DISTINCT height) FROM {txs}) AS n_blocks, count(DISTINCT address) AS n_addresses, count(*) AS n_outputs, count(DISTINCT CASE WHEN value = 0 THEN 0 ELSE length(CAST(value AS STRING)) END) AS n_buckets FROM {tx_outputs}",
)
register_sql("mempool_info", "SELECT count(*) AS size, CAST(sum(vsize) AS BIGINT) AS bytes, 250 * count(*) AS bytes_estimate, CAST(sum(fee) AS BIGINT) AS total_fee FROM {mempool}")
register_sql("mempool_size_mib", "SELECT CAST(CAST(sum(vsize) AS BIGINT) div 1048576 AS BIGINT) AS mib FROM {mempool}")
register_sql(
    "mempool_entries",
    """SELECT m.txid, m.fee, m.vsize, CAST(coalesce(p.n, 0) AS BIGINT) AS n_parents, CAST(coalesce(p.fees, 0) AS BIGINT) AS parent_fees, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children, CAST(coalesce(c.fees, 0) AS BIGINT) AS child_fees FROM {mempool} m
    LEFT JOIN (SELECT e.child AS txid, count(*) AS n, sum(x.fee) AS fees FROM {pool_edges} e JOIN {mempool} x ON x.txid = e.parent GROUP BY e.child) p ON p.txid = m.txid
    LEFT JOIN (SELECT e.parent AS txid, count(*) AS n, sum(x.fee) AS fees FROM {pool_edges} e JOIN {mempool} x ON x.txid = e.child GROUP BY e.parent) c ON c.txid = m.txid""",
)
register_sql(
    "smart_fee_estimate",
    "SELECT max(CASE WHEN r = n div 2 THEN fee_rate END) AS median_rate, CAST(floor(max(CASE WHEN r = n div 2 THEN fee_rate END) * 0.8) AS BIGINT) AS economical, CAST(floor(max(CASE WHEN r = n div 2 THEN fee_rate END) * 1.2) AS BIGINT) AS conservative FROM (SELECT fee_rate, row_number() OVER (ORDER BY fee_rate, txid) - 1 AS r, count(*) OVER () AS n FROM (SELECT fee_rate, txid FROM {mempool} ORDER BY fee_rate DESC, txid LIMIT 100) a) b",
)


def nearest_rank(of: str, n: str) -> str:
    """SQL over rows (of, upto), distinct values with how many rows are at or below each: the value at place n of the rows in order, from 0."""
    return f"min(CASE WHEN upto > {n} THEN {of} END)"


register_sql(
    "fee_estimate_by_target",
    f"SELECT target, CAST(floor(median * scale) AS BIGINT) AS rate FROM (SELECT {nearest_rank('fee_rate', 'n div 2')} AS median FROM (SELECT fee_rate, sum(c) OVER (ORDER BY fee_rate) AS upto, sum(c) OVER () AS n FROM (SELECT fee_rate, count(*) AS c FROM {{mempool}} GROUP BY fee_rate) g) a) m JOIN (SELECT 1 AS target, 2.0 AS scale UNION ALL SELECT 3, 1.5 UNION ALL SELECT 6, 1.0 UNION ALL SELECT 12, 0.5) s ON 1 = 1",
    "SELECT target, floor(median * scale)::BIGINT AS rate FROM (SELECT list_sort(list(fee_rate))[(count(*) // 2 + 1)::INT] AS median FROM mempool) m, (VALUES (1, 2.0), (3, 1.5), (6, 1.0), (12, 0.5)) s(target, scale)",
)
register_sql(
    "congestion_metrics",
    "SELECT count(*) AS mempool_size, 1 + least(count(*) div 1000, 10) AS avg_fee_heuristic, round(avg(fee_rate), 6) AS avg_fee_rate, greatest(1, count(*) div 2000) AS estimated_blocks, CASE WHEN count(*) < 1000 THEN 'low' WHEN count(*) < 5000 THEN 'medium' WHEN count(*) < 20000 THEN 'high' ELSE 'critical' END AS level FROM {mempool}",
)


# Equal amounts are counted before anything is sorted, so that a window sees distinct values, not all events of a kind.
register_sql(
    "operation_stats",
    f"SELECT kind, CAST(max(n) AS BIGINT) AS n, round(sum(total) / max(n), 6) AS mean, min(amount) AS least, max(amount) AS most, {', '.join(nearest_rank('amount', f'n * {p} div 100') + f' AS p{p}' for p in (50, 95, 99))} FROM (SELECT kind, amount, total, sum(c) OVER (PARTITION BY kind ORDER BY amount) AS upto, sum(c) OVER (PARTITION BY kind) AS n FROM (SELECT kind, amount, count(*) AS c, sum(amount) AS total FROM {{peer_samples}} GROUP BY kind, amount) g) t GROUP BY kind",
    f"SELECT kind, max(n) AS n, round(avg(amount), 6) AS mean, min(amount) AS least, max(amount) AS most, {', '.join(f'max(CASE WHEN r = n * {p} // 100 THEN amount END) AS p{p}' for p in (50, 95, 99))} FROM (SELECT kind, amount, row_number() OVER (PARTITION BY kind ORDER BY amount, event_id) - 1 AS r, count(*) OVER (PARTITION BY kind) AS n FROM peer_samples) t GROUP BY kind",
)
register_sql(
    "peer_summary",
    "SELECT count(*) AS peers, CAST(sum(n) AS BIGINT) AS samples, CAST(100 * sum(CASE WHEN peer % 10 = 0 THEN 1 ELSE 0 END) div count(*) AS BIGINT) AS lan_percent, max_by(peer, n * 1000000 - peer) AS busiest FROM (SELECT peer, count(*) AS n FROM {peer_samples} GROUP BY peer) t",
)
register_sql(
    "trust_counts",
    "SELECT count_if(n >= 100) AS trusted, count_if(n >= 50 AND n < 100) AS known, count_if(n < 50) AS fresh, count(*) AS total FROM (SELECT peer, count(*) AS n FROM {peer_samples} GROUP BY peer) t",
)
register_sql("net_totals", "SELECT CAST(sum(CASE WHEN kind IN ('view', 'click') THEN round(amount * 100) ELSE 0 END) AS BIGINT) AS received, CAST(sum(CASE WHEN kind NOT IN ('view', 'click') THEN round(amount * 100) ELSE 0 END) AS BIGINT) AS sent, count(*) AS messages FROM {peer_samples}")
register_sql(
    "health_report",
    "SELECT max(code) AS code, CASE max(code) WHEN 0 THEN 'Healthy' WHEN 1 THEN 'Degraded' WHEN 2 THEN 'Unhealthy' ELSE 'Down' END AS status FROM (SELECT kind, CASE WHEN count(*) = 0 THEN 3 WHEN count_if(amount < 0) > 0 THEN 2 WHEN count_if(amount < 1) * 10 > count(*) THEN 1 ELSE 0 END AS code FROM {peer_samples} GROUP BY kind) t",
)
register_sql(
    "node_metrics",
    "SELECT (SELECT count(*) FROM {blocks}) AS block_count, (SELECT count(*) FROM {utxos}) AS utxo_count, (SELECT count(*) FROM {mempool}) AS mempool_count, (SELECT count(DISTINCT peer) FROM {peer_samples}) AS peer_count, (SELECT max(sec) FROM {peer_samples}) AS last_seen",
)
register_sql("pruning_stats", "SELECT count_if(height < (SELECT max(height) FROM {blocks}) - 288) AS pruned, count_if(height >= (SELECT max(height) FROM {blocks}) - 288) AS kept, min(CASE WHEN height >= (SELECT max(height) FROM {blocks}) - 288 THEN height END) AS first_body FROM {blocks}")
register_sql("relay_stats", "SELECT count(DISTINCT CASE WHEN sec > (SELECT max(sec) FROM {peer_samples}) - 3600 THEN event_id END) AS recent_txs, count(DISTINCT CASE WHEN sec > (SELECT max(sec) FROM {peer_samples}) - 86400 THEN peer END) AS recent_peers, count(*) AS total FROM {peer_samples}")
register_sql("audit_log_tail", "SELECT event_id, peer, kind, sec FROM {peer_samples} ORDER BY sec DESC, event_id DESC LIMIT 50")
register_sql("latest_metrics", "SELECT peer, kind, max_by(event_id, sec * 1000000 + event_id % 1000000) AS last_event, max(sec) AS sec FROM {peer_samples} GROUP BY peer, kind")
register_sql("package_fees", "SELECT CAST(added_seq div 25 AS BIGINT) AS package, count(*) AS n, CAST(sum(fee) AS BIGINT) AS fees, CAST(sum(68 * n_in + 31 * n_out + 10) AS BIGINT) AS weight, round(CAST(sum(fee) AS DOUBLE) / (sum(68 * n_in + 31 * n_out + 10) / 4.0), 6) AS fee_rate FROM {mempool} GROUP BY added_seq div 25")


@register("distinct_addresses", "SELECT count(*) AS n FROM (SELECT address FROM tx_outputs GROUP BY address)")
def _exact(ledger: Ledger) -> DataFrame:
    return ledger["tx_outputs"].agg(F.countDistinct("address").alias("n"))


@register("approximate_addresses")
def _sketched(ledger: Ledger) -> DataFrame:
    return address_sketch(ledger["tx_outputs"])


def address_sketch(outputs: DataFrame, relative_error: float = 0.02) -> DataFrame:
    """Estimate of distinct addresses by a HyperLogLog sketch of this relative standard deviation."""
    return outputs.agg(F.approx_count_distinct("address", relative_error).alias("n"))
