"""The unspent set as a versioned relation: a log of additions and deletions by height, and its state as of any of them.

The latest operation on an output decides; on a tie of heights a deletion wins. State at a height is one aggregation with partial sums, however
long the log: no replay and no sort of a key's whole history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.registry import register, register_sql
from chainweave.views import Ledger


def live_at(ops: DataFrame, height: int | None = None, inclusive: bool = True) -> DataFrame:
    """(txid, vout, height) of outputs whose latest operation up to `height` is an addition. Rank doubles the height, plus 1 for a deletion, so that the largest rank is the latest operation."""
    if height is not None:
        ops = ops.filter(F.col("height") <= height if inclusive else F.col("height") < height)
    rank = F.col("height") * 2 + (F.col("op") == "D").cast("int")
    last = ops.groupBy("txid", "vout").agg(F.max(rank).alias("last"))
    return last.filter("last % 2 = 0").select("txid", "vout", F.expr("last div 2").alias("height"))


def compact(ops: DataFrame, fence: int) -> DataFrame:
    """The log without outputs that are both added and deleted at heights up to the fence; later operations stay as they are."""
    old = F.col("height") <= fence
    state = ops.groupBy("txid", "vout").agg(F.max((old & (F.col("op") == "A")).cast("int")).alias("a"), F.max((old & (F.col("op") == "D")).cast("int")).alias("d"))
    dead = state.filter("a = 1 AND d = 1").select("txid", "vout", F.lit(True).alias("dead"))
    return ops.join(dead, ["txid", "vout"], "left").filter(F.col("dead").isNull() | (F.col("height") > fence)).select("txid", "vout", "height", "op")


def apply_delta(state: DataFrame, deletions: DataFrame, additions: DataFrame) -> DataFrame:
    """A state without what is deleted, and with what is added; keys (txid, vout)."""
    return state.join(deletions, ["txid", "vout"], "left_anti").unionByName(additions.select(*state.columns))


def overlay(base: DataFrame, pending: DataFrame, keys: list[str]) -> DataFrame:
    """Reads through writes that aren't flushed: pending rows (with op, A or D, and seq) stand over the base, a key's last one deciding; columns of base."""
    rest = [c for c in base.columns if c not in keys]
    last = pending.groupBy(*keys).agg(F.max_by(F.struct("op", *rest), "seq").alias("p"))
    kept = base.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.filter("p.op = 'A'").select(*keys, *[F.col(f"p.{c}").alias(c) for c in rest]))


def either(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the first source, and of the second those whose keys the first lacks."""
    return first.unionByName(second.select(*first.columns).join(first.select(*keys), keys, "left_anti"))


def missing_heights(heights: DataFrame, first: int, last: int) -> DataFrame:
    """Heights from first to last that a relation lacks: a range of them is an error to whoever folds it."""
    return heights.sparkSession.range(first, last + 1).select(F.col("id").alias("height")).join(heights, "height", "left_anti")


_LIVE = "SELECT txid, vout, max(CASE WHEN op = 'A' THEN height END) AS height FROM utxo_ops {where} GROUP BY txid, vout HAVING max(2 * height + CASE WHEN op = 'D' THEN 1 ELSE 0 END) % 2 = 0"

register_sql("utxo_ops_appended", "SELECT txid, vout, height, op FROM {utxo_ops} WHERE height BETWEEN 500 AND 520")
register_sql("same_block_spends", "SELECT i.height, count(*) AS n FROM {tx_inputs} i JOIN {txs} t ON t.txid = i.prev_txid AND t.height = i.height GROUP BY i.height")
register_sql("ops_in_merge_order", "SELECT txid, vout, height, op, CAST(row_number() OVER (PARTITION BY txid, vout ORDER BY height DESC, op) AS BIGINT) AS place FROM {utxo_ops}")
register_sql(
    "utxo_lookup_latest",
    "SELECT txid, vout, height FROM (SELECT txid, vout, height, op, row_number() OVER (PARTITION BY txid, vout ORDER BY height DESC, op DESC) AS r FROM {utxo_ops}) t WHERE r = 1 AND op = 'A'",
)
register_sql(
    "utxo_batch_query_before",
    "SELECT txid, vout, height, op FROM (SELECT o.txid, o.vout, o.height, o.op, row_number() OVER (PARTITION BY o.txid, o.vout ORDER BY o.height DESC, o.op DESC) AS r FROM {utxo_ops} o JOIN (SELECT DISTINCT prev_txid, prev_vout FROM {tx_inputs} WHERE height = 600) k ON k.prev_txid = o.txid AND k.prev_vout = o.vout WHERE o.height < 600) t WHERE r = 1",
)


@register("utxo_all_live", _LIVE.format(where=""))
def _all_live(ledger: Ledger) -> DataFrame:
    return live_at(ledger["utxo_ops"])


@register("utxo_live_at_height", _LIVE.format(where="WHERE height <= 500"))
def _live_500(ledger: Ledger) -> DataFrame:
    return live_at(ledger["utxo_ops"], 500)


@register("utxo_reconstructed_before", _LIVE.format(where="WHERE height < 700"))
def _before_700(ledger: Ledger) -> DataFrame:
    return live_at(ledger["utxo_ops"], 700, inclusive=False)


register_sql("ops_erased_since", "SELECT txid, vout, height, op FROM {utxo_ops} WHERE height < 800")


@register(
    "ops_compacted",
    """SELECT o.txid, o.vout, o.height, o.op FROM utxo_ops o WHERE o.height > 600 OR NOT EXISTS (SELECT 1 FROM (SELECT txid, vout FROM utxo_ops WHERE height <= 600
    GROUP BY txid, vout HAVING count(DISTINCT op) = 2) d WHERE d.txid = o.txid AND d.vout = o.vout)""",
)
def _compacted(ledger: Ledger) -> DataFrame:
    return compact(ledger["utxo_ops"], 600)


@register(
    "utxo_delta_applied",
    """SELECT txid, vout, height FROM (%s) s WHERE NOT EXISTS (SELECT 1 FROM tx_inputs i WHERE i.height = 501 AND i.prev_txid = s.txid AND i.prev_vout = s.vout)
    UNION ALL SELECT txid, vout, height FROM tx_outputs o WHERE height = 501""" % _LIVE.format(where="WHERE height <= 500"),
)
def _delta(ledger: Ledger) -> DataFrame:
    gone = ledger["tx_inputs"].filter("height = 501").select(F.col("prev_txid").alias("txid"), F.col("prev_vout").alias("vout"))
    return apply_delta(live_at(ledger["utxo_ops"], 500), gone, ledger["tx_outputs"].filter("height = 501"))


@register("utxo_folded_deltas", _LIVE.format(where="WHERE height BETWEEN 300 AND 400"))
def _folded(ledger: Ledger) -> DataFrame:
    """What blocks 300 to 400 leave of their own outputs."""
    return live_at(ledger["utxo_ops"].filter("height >= 300"), 400)


@register("missing_heights", "SELECT i AS height FROM range(0, 601) r(i) WHERE i NOT IN (SELECT height FROM blocks WHERE height % 50 <> 3)")
def _missing(ledger: Ledger) -> DataFrame:
    return missing_heights(ledger["blocks"].filter("height % 50 <> 3"), 0, 600)


@register(
    "utxo_with_pending_writes",
    "SELECT txid, vout, value FROM utxos WHERE height <> 700 UNION ALL SELECT txid, vout, value + 1 FROM utxos WHERE height = 700 AND vout % 2 = 0",
)
def _overlaid(ledger: Ledger) -> DataFrame:
    """Outputs of a block are written anew and then, every second one, deleted."""
    base = ledger["utxos"].select("txid", "vout", "value")
    changed = ledger["utxos"].filter("height = 700").select("txid", "vout", (F.col("value") + 1).alias("value"))
    pending = changed.select("*", F.lit("A").alias("op"), F.lit(1).alias("seq")).unionByName(changed.filter("vout % 2 = 1").select("*", F.lit("D").alias("op"), F.lit(2).alias("seq")))
    return overlay(base, pending, ["txid", "vout"])


@register("block_from_either_source", "SELECT height, block_hash, CASE WHEN height % 3 = 0 THEN 'flat' ELSE 'store' END AS origin FROM blocks")
def _either(ledger: Ledger) -> DataFrame:
    some = ledger["blocks"].select("height", "block_hash")
    return either(some.filter("height % 3 <> 0").withColumn("origin", F.lit("store")), some.withColumn("origin", F.lit("flat")), ["block_hash"])


register_sql(
    "commitments_every_144",
    "SELECT height, CAST(sum(n) OVER (ORDER BY height) AS BIGINT) AS outputs, CAST(sum(v) OVER (ORDER BY height) AS BIGINT) AS amount FROM (SELECT g.height, CAST(sum(g.n) AS BIGINT) AS n, CAST(sum(g.v) AS BIGINT) AS v FROM (SELECT CAST((height + 143) div 144 * 144 AS BIGINT) AS height, count(*) AS n, sum(value) AS v FROM {tx_outputs} GROUP BY (height + 143) div 144 * 144 UNION ALL SELECT CAST((i.height + 143) div 144 * 144 AS BIGINT) AS height, -count(*) AS n, -sum(o.value) AS v FROM {tx_inputs} i JOIN {tx_outputs} o ON o.txid = i.prev_txid AND o.vout = i.prev_vout GROUP BY (i.height + 143) div 144 * 144) g GROUP BY g.height) t",
)
