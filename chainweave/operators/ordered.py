"""Windows over the chain, ordered selections and eviction orders.

Greedy selections are prefix sums: a rule that stops at its first violation selects exactly the rows before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainweave.functions.hashing import block_work, chainwork_hex, difficulty
from chainweave.registry import register, register_sql
from chainweave.views import Ledger


@register(
    "chainwork",
    "SELECT height, block_hash, work::VARCHAR AS work, lpad(printf('%x', work::BIGINT), 64, '0') AS chainwork FROM (SELECT height, block_hash, sum((281474976710656 - 1) // (bits % 16777216)) OVER (ORDER BY height) AS work FROM blocks)",
)
def _chainwork(ledger: Ledger) -> DataFrame:
    """Work of a block and all before it, exact, in digits and as interfaces show it."""
    worked = ledger["blocks"].select("height", "block_hash", block_work(F.col("bits")).alias("own"))
    total = worked.select("height", "block_hash", F.sum("own").over(Window.orderBy("height").rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(38,0)").alias("total"))
    return total.select("height", "block_hash", F.col("total").cast("string").alias("work"), chainwork_hex(F.col("total")).alias("chainwork"))


@register("block_difficulty", "SELECT height, bits, round(65535.0::DOUBLE / (bits % 16777216), 9) AS difficulty FROM blocks")
def _difficulty(ledger: Ledger) -> DataFrame:
    return ledger["blocks"].select("height", "bits", F.round(difficulty(F.col("bits")), 9).alias("difficulty"))


register_sql("confirmations", "SELECT height, greatest((SELECT max(height) FROM {blocks}) - height + 1, 0) AS confirmations FROM {blocks}")
register_sql("recent_headers", "SELECT height, block_hash, ts FROM (SELECT height, block_hash, ts FROM {blocks} ORDER BY height DESC LIMIT 11) t ORDER BY height")
register_sql("linkage_check", "SELECT height, prev_hash = expected AS linked FROM (SELECT height, prev_hash, lag(block_hash) OVER (ORDER BY height) AS expected FROM {blocks} WHERE height >= (SELECT max(height) FROM {blocks}) - 288) t WHERE expected IS NOT NULL")
register_sql("header_walk", "SELECT height, block_hash, lag(block_hash) OVER (ORDER BY height) = prev_hash AS follows FROM {blocks} WHERE height BETWEEN 100 AND 400")
register_sql("hashrate_by_height", "SELECT height, n, seconds FROM (SELECT height, count(*) OVER w AS n, ts - min(ts) OVER w AS seconds FROM {blocks} WINDOW w AS (ORDER BY height ROWS BETWEEN 143 PRECEDING AND CURRENT ROW)) t")
register_sql("retarget_periods", "SELECT CAST(height div 144 AS BIGINT) AS period, count(*) AS n, max(ts) - min(ts) AS seconds, round(CAST(max(ts) - min(ts) AS DOUBLE) / (600.0 * 143), 9) AS ratio FROM {blocks} GROUP BY height div 144")
register_sql("kept_heights", "SELECT height, block_hash FROM {blocks} WHERE height >= (SELECT max(height) FROM {blocks}) - 144")
register_sql("height_chunks", "SELECT CAST(height div 128 AS BIGINT) AS chunk, min(height) AS first, max(height) AS last, CAST(height div 128 % 8 AS BIGINT) AS peer FROM {blocks} GROUP BY height div 128, height div 128 % 8")


@register("median_time_past", "SELECT height, list_sort(list(ts) OVER (ORDER BY height ROWS BETWEEN 10 PRECEDING AND CURRENT ROW))[(least(height + 1, 11) // 2 + 1)::INT] AS median_time FROM blocks")
def _median_time(ledger: Ledger) -> DataFrame:
    """The upper median of a block's and its ten predecessors' times."""
    w = Window.orderBy("height").rowsBetween(-10, 0)
    b = ledger["blocks"].withColumn("times", F.sort_array(F.collect_list("ts").over(w)))
    return b.select("height", F.get("times", F.expr("size(times) div 2")).alias("median_time"))


#: Weight that a new sample has in a peer's running latency, and the latency before the first.
EMA_NEW, EMA_START = 0.3, 1000.0


@register("peer_latency_ema", "SELECT peer, round(list_reduce(list_prepend(1000.0::DOUBLE, list(amount ORDER BY sec, event_id)), lambda a, x: a * 0.7::DOUBLE + x * 0.3::DOUBLE), 6) AS latency FROM peer_samples GROUP BY peer")
def _ema(ledger: Ledger) -> DataFrame:
    """v = 0.7 v + 0.3 x, unrolled: a sample that k others follow weighs 0.3 * 0.7 ** k, so that partial sums do and no list of a peer's samples is built."""
    s = ledger["peer_samples"]
    later = F.row_number().over(Window.partitionBy("peer").orderBy(F.desc("sec"), F.desc("event_id"))) - 1
    s = s.withColumn("later", later)
    old = 1 - EMA_NEW
    total = F.sum(F.col("amount") * EMA_NEW * F.pow(F.lit(old), F.col("later"))) + EMA_START * F.pow(F.lit(old), F.count(F.lit(1)))
    return s.groupBy("peer").agg(F.round(total, 6).alias("latency"))


register_sql("prioritized_transactions", "SELECT txid, fee_rate, added_seq FROM {mempool} ORDER BY fee_rate DESC, added_seq LIMIT 100")


def select_template(pool: DataFrame, max_size: int, max_weight: int, min_rate: int, most: int = 1000) -> DataFrame:
    """A block template: by fee rate, then arrival; transactions below min_rate are skipped and cost nothing; the first that would exceed a limit ends the selection. Of the pool, the best `most` are looked at, as a part of the rule."""
    best = pool.orderBy(F.desc("fee_rate"), "added_seq").limit(most)
    order = Window.orderBy(F.desc("fee_rate"), "added_seq")
    pays = F.col("fee_rate") >= min_rate
    before = lambda c: F.coalesce(F.sum(F.when(pays, c).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + c
    over = pays & ((before(F.col("vsize")) > max_size) | (before(F.col("vsize") * 4) > max_weight))
    rows = best.withColumn("over", over).withColumn("stopped", F.max("over").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter(pays & ~F.col("stopped")).select("txid", "fee_rate", "vsize", "added_seq")


@register(
    "block_template",
    """WITH b AS (SELECT * FROM mempool ORDER BY fee_rate DESC, added_seq LIMIT 1000),
    c AS (SELECT *, coalesce(sum(CASE WHEN fee_rate >= 1000 THEN vsize ELSE 0 END) OVER (ORDER BY fee_rate DESC, added_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + vsize AS upto FROM b),
    d AS (SELECT *, max(CASE WHEN fee_rate >= 1000 AND (upto > 50000 OR 4 * upto > 400000) THEN 1 ELSE 0 END) OVER (ORDER BY fee_rate DESC, added_seq ROWS UNBOUNDED PRECEDING) AS stopped FROM c)
    SELECT txid, fee_rate, vsize, added_seq FROM d WHERE fee_rate >= 1000 AND stopped = 0""",
)
def _template(ledger: Ledger) -> DataFrame:
    return select_template(ledger["mempool"], 50_000, 400_000, 1000)


def evict(pool: DataFrame, order: list, target_bytes: int) -> DataFrame:
    """Rows to evict, first in `order` first, until what stays is at most target_bytes."""
    total = pool.agg(F.sum("vsize").alias("total"))
    w = Window.orderBy(*order, "txid")
    rows = pool.withColumn("before", F.coalesce(F.sum("vsize").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(total)).filter(F.col("before") < F.col("total") - target_bytes).select("txid", "fee_rate", "vsize", "added_seq")


_EVICT = "SELECT txid, fee_rate, vsize, added_seq FROM (SELECT *, coalesce(sum(vsize) OVER (ORDER BY {order}, txid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(vsize) OVER () AS total FROM {pool}) t WHERE before < total - 100000"
_LEAVES = "(SELECT * FROM mempool m WHERE NOT EXISTS (SELECT 1 FROM pool_edges e WHERE e.parent = m.txid)) x"
_HYBRID = "CASE WHEN fee_rate > 0 THEN 1000000 // (fee_rate + 1) ELSE 1000000 END + ((SELECT max(added_at) FROM mempool) - added_at) // 3600"


def leaves(ledger: Ledger) -> DataFrame:
    """Pending transactions that none other spends."""
    return ledger["mempool"].join(ledger["pool_edges"].select(F.col("parent").alias("txid")), "txid", "left_anti")


@register("evict_lowest_fee_rate", _EVICT.format(order="fee_rate", pool=_LEAVES))
def _lowest(ledger: Ledger) -> DataFrame:
    return evict(leaves(ledger), [F.col("fee_rate")], 100_000)


@register("evict_oldest_first", _EVICT.format(order="added_seq", pool="mempool"))
def _oldest(ledger: Ledger) -> DataFrame:
    return evict(ledger["mempool"], [F.col("added_seq")], 100_000)


@register("evict_largest_first", _EVICT.format(order="vsize DESC", pool="mempool"))
def _largest(ledger: Ledger) -> DataFrame:
    return evict(ledger["mempool"], [F.desc("vsize")], 100_000)


@register("evict_no_descendants_first", _EVICT.format(order="parent, fee_rate", pool="(SELECT m.*, EXISTS (SELECT 1 FROM pool_edges e WHERE e.parent = m.txid) AS parent FROM mempool m) x"))
def _no_descendants(ledger: Ledger) -> DataFrame:
    parents = ledger["pool_edges"].select(F.col("parent").alias("txid"), F.lit(True).alias("parent")).distinct()
    pool = ledger["mempool"].join(parents, "txid", "left").withColumn("parent", F.coalesce("parent", F.lit(False)))
    return evict(pool, [F.col("parent"), F.col("fee_rate")], 100_000)


@register("evict_hybrid", _EVICT.format(order="score DESC", pool=f"(SELECT *, {_HYBRID} AS score FROM mempool) x"))
def _hybrid(ledger: Ledger) -> DataFrame:
    pool = ledger["mempool"]
    newest = pool.agg(F.max("added_at").alias("newest"))
    score = F.expr("CASE WHEN fee_rate > 0 THEN 1000000 div (fee_rate + 1) ELSE 1000000 END + (newest - added_at) div 3600")
    return evict(pool.join(F.broadcast(newest)).withColumn("score", score), [F.desc("score")], 100_000)


@register("evict_spam_first", _EVICT.format(order="spam DESC, fee_rate", pool="(SELECT *, n_out > 6 AS spam FROM mempool) x"))
def _spam(ledger: Ledger) -> DataFrame:
    """Spam, here many outputs, is a predicate of the caller's."""
    return evict(ledger["mempool"].withColumn("spam", F.col("n_out") > 6), [F.desc("spam"), F.col("fee_rate")], 100_000)


#: Eviction orders by name, as limits enforce them.
STRATEGIES = {"lowest_fee_rate": _lowest, "oldest_first": _oldest, "largest_first": _largest, "no_descendants_first": _no_descendants, "hybrid": _hybrid, "spam_first": _spam}


def enforce_limits(ledger: Ledger, strategy: str, max_bytes: int, max_count: int) -> DataFrame:
    """Rows that a strategy evicts, none while the pool is within both limits."""
    size, n = ledger["mempool"].agg(F.sum("vsize"), F.count(F.lit(1))).first()
    found = STRATEGIES[strategy](ledger)
    return found if (size or 0) > max_bytes or n > max_count else found.limit(0)


register_sql("expired_transactions", "SELECT txid, added_at FROM {mempool} WHERE added_at < (SELECT max(added_at) FROM {mempool}) - 336 * 3600 div 10")
