"""Payments, vaults, pools and batches as latest states and transitions, and pruning as conditional rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.registry import register, register_sql
from chainweave.views import Ledger

#: States of a payment that a transition may start from.
TRANSITIONS = {"settled": ("created", "in_pool", "reorg_pending"), "failed": ("created", "in_pool", "reorg_pending"), "reorg_pending": ("settled",), "in_pool": ("created", "reorg_pending")}


def latest(states: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last state row of every key, by one aggregation; states are only ever appended."""
    rest = [c for c in states.columns if c not in (key, order)]
    last = states.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("s"), F.max(order).alias(order))
    return last.select(key, order, *[F.col(f"s.{c}").alias(c) for c in rest])


def transition(states: DataFrame, changes: DataFrame, to: str) -> DataFrame:
    """Rows to append for changes (id, seq): those whose payment is in a state that `to` may follow."""
    now = latest(states).filter(F.col("state").isin(*TRANSITIONS[to])).select("id")
    return changes.join(now, "id", "left_semi").select("id", "seq", F.lit(to).alias("state"))


def _states(ledger: Ledger) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "P", "created").when(F.col("o_orderstatus") == "O", "in_pool").otherwise("settled")
    return ledger["orders"].select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), state.alias("state"))


_STATES = "states AS (SELECT o_custkey AS id, o_orderkey AS seq, CASE o_orderstatus WHEN 'P' THEN 'created' WHEN 'O' THEN 'in_pool' ELSE 'settled' END AS state FROM orders)"


@register("payment_states", f"WITH {_STATES} SELECT id, max(seq) AS seq, max_by(state, seq) AS state FROM states GROUP BY id")
def _latest(ledger: Ledger) -> DataFrame:
    return latest(_states(ledger)).select("id", "seq", "state")


@register("payments_to_reorg", f"WITH {_STATES} SELECT id, max(seq) + 1 AS seq, 'reorg_pending' AS state FROM states GROUP BY id HAVING max_by(state, seq) = 'settled'")
def _reorg(ledger: Ledger) -> DataFrame:
    states = _states(ledger)
    changes = states.groupBy("id").agg((F.max("seq") + 1).alias("seq"))
    return transition(states, changes, "reorg_pending")


@register("payments_by_state", f"WITH {_STATES} SELECT state, count(*) AS n FROM (SELECT id, max_by(state, seq) AS state FROM states GROUP BY id) t GROUP BY state")
def _by_state(ledger: Ledger) -> DataFrame:
    return latest(_states(ledger)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


register_sql(
    "reorged_payments",
    "SELECT t.txid, t.height, CASE WHEN t.pending THEN 'in_pool' WHEN t.height >= 600 THEN 'reorg_pending' ELSE 'settled' END AS state FROM {txs} t WHERE t.height BETWEEN 590 AND 610",
)
register_sql("vaults_withdrawable", "SELECT o_custkey AS vault, max(o_orderkey) AS last_op, (SELECT max(height) FROM {blocks}) >= max(o_orderkey) % 3000 + 144 AS eligible FROM {orders} GROUP BY o_custkey")
register_sql("pool_balances", "SELECT l_suppkey AS participant, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS balance FROM {lineitem} GROUP BY l_suppkey")


def distribute(amounts: DataFrame, fee_percent: int) -> DataFrame:
    """(participant, amount) with fee, amount * percent div 100, and net."""
    fee = F.expr(f"amount * {fee_percent} div 100")
    return amounts.withColumn("fee", fee).withColumn("net", F.col("amount") - F.col("fee"))


@register("pool_distribution", "SELECT l_suppkey AS participant, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS amount, (sum(round(l_extendedprice * 100)::BIGINT) * 3 // 100)::BIGINT AS fee, (sum(round(l_extendedprice * 100)::BIGINT) - sum(round(l_extendedprice * 100)::BIGINT) * 3 // 100)::BIGINT AS net FROM lineitem GROUP BY l_suppkey")
def _distribute(ledger: Ledger) -> DataFrame:
    sums = ledger["lineitem"].groupBy(F.col("l_suppkey").alias("participant")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("amount"))
    return distribute(sums, 3)


register_sql("pool_after_exit", "SELECT l_suppkey AS participant, CAST(greatest(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END * CAST(round(l_extendedprice * 100) AS BIGINT)), 0) AS BIGINT) AS balance FROM {lineitem} GROUP BY l_suppkey")


@register(
    "batches_to_broadcast",
    """SELECT batch, n, n > 0 AND (n >= 100 OR urgent OR waited > 86400 OR cheap) AS broadcast FROM (SELECT added_seq // 50 AS batch, count(*) AS n, bool_or(fee > 5000000) AS urgent,
    (SELECT max(added_at) FROM mempool) - min(added_at) AS waited, avg(fee_rate) < 1000 AS cheap FROM mempool GROUP BY added_seq // 50) t""",
)
def _batches(ledger: Ledger) -> DataFrame:
    """A batch goes out if it is full, urgent, old, or fees are low."""
    m = ledger["mempool"]
    newest = m.agg(F.max("added_at").alias("now"))
    b = m.groupBy(F.expr("added_seq div 50").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("fee") > 5_000_000).alias("urgent"), F.min("added_at").alias("since"), (F.avg("fee_rate") < 1000).alias("cheap"))
    go = (F.col("n") > 0) & ((F.col("n") >= 100) | F.col("urgent") | (F.col("now") - F.col("since") > 86400) | F.col("cheap"))
    return b.join(F.broadcast(newest)).select("batch", "n", go.alias("broadcast"))


register_sql("batch_fee_adjusted", "SELECT CAST(added_seq div 50 AS BIGINT) AS batch, CASE WHEN (SELECT count(*) FROM {mempool}) > 100 THEN greatest(CAST(floor(avg(fee_rate)) AS BIGINT), 1000) ELSE 1000 END AS fee_rate FROM {mempool} GROUP BY added_seq div 50")


def prune(blocks: DataFrame, target: int, keep_from: int, recent: int = 288) -> DataFrame:
    """blocks with has_body: bodies below the target, keep_from and the last `recent` heights go, headers stay."""
    tip = blocks.agg(F.max("height").alias("tip"))
    floor = F.least(F.lit(target), F.greatest(F.lit(keep_from), F.col("tip") - recent))
    return blocks.join(F.broadcast(tip)).withColumn("has_body", F.col("height") >= floor).drop("tip")


@register("pruned_blocks", "SELECT height, block_hash, height >= least(700, greatest(200, (SELECT max(height) FROM blocks) - 288)) AS has_body FROM blocks")
def _pruned(ledger: Ledger) -> DataFrame:
    return prune(ledger["blocks"], 700, 200).select("height", "block_hash", "has_body")


def prune_aggressively(blocks: DataFrame, target: int, keep_from: int, keep_commitments: bool = True, keep_filtered: bool = False, recent: int = 144) -> DataFrame:
    """blocks as prune leaves them, with what goes besides: below the same height filters, and witnesses unless filtered blocks are kept. has_commitment: whether a commitment was written before the body went."""
    gone = ~F.col("has_body")
    return prune(blocks, target, keep_from, recent).withColumns({"has_witness": ~gone | F.lit(keep_filtered), "has_filter": ~gone, "has_commitment": gone & F.lit(keep_commitments)})


def prune_components(blocks: DataFrame, target: int, bodies_from: int, keep_headers: bool = True, keep_commitments: bool = True, keep_filters: bool = True, keep_witnesses: bool = False) -> DataFrame:
    """blocks with a flag for each component that stays. The height is the lower of target and bodies_from, without regard to the tip; headers of filters always stay, and a kept filter leaves the cache only."""
    gone = F.col("height") < min(target, bodies_from)
    return blocks.withColumns({"has_header": F.lit(keep_headers) | ~gone, "has_body": ~gone, "has_witness": ~gone | F.lit(keep_witnesses), "has_commitment": gone & F.lit(keep_commitments), "filter_cached": ~(gone & F.lit(keep_filters))})


@register("pruned_aggressively", "SELECT height, height >= f AS has_body, height >= f AS has_witness, height >= f AS has_filter, height < f AS has_commitment FROM blocks, (SELECT least(900, greatest(100, max(height) - 144)) AS f FROM blocks) x")
def _aggressively(ledger: Ledger) -> DataFrame:
    return prune_aggressively(ledger["blocks"], 900, 100).select("height", "has_body", "has_witness", "has_filter", "has_commitment")


@register("pruned_components", "SELECT height, TRUE AS has_header, height >= 400 AS has_body, TRUE AS has_witness, FALSE AS has_commitment, height >= 400 AS filter_cached FROM blocks")
def _components(ledger: Ledger) -> DataFrame:
    kept = prune_components(ledger["blocks"], 1000, 400, keep_commitments=False, keep_witnesses=True)
    return kept.select("height", "has_header", "has_body", "has_witness", "has_commitment", "filter_cached")


register_sql("auto_prune_due", "SELECT max(height) AS height, max(height) >= 500 + 144 AS due FROM {blocks}")
register_sql("recovered_tip", "SELECT max_by(block_hash, height) AS block_hash, max(height) AS height, max_by(ts, height) AS ts FROM {blocks}")
