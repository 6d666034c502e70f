"""Private relay: transactions walk a stem of single peers until they are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweave.registry import register
from chainweave.views import Ledger

#: Seconds that a stem may last, hops that it may have, and the share of transactions that each look broadcasts by chance.
STEM_SECONDS, MAX_HOPS, FLUFF_SHARE = 10, 2, 0.1


def draw(of: Column, look: Column) -> Column:
    """A number from 0 to 1 that depends on a transaction and the look at it alone, so that reruns decide alike."""
    digits = F.substring(F.sha2(F.concat_ws(":", of.cast("string"), look.cast("string")), 256), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 32)


def stem_decisions(states: DataFrame, now: Column, seconds: int = STEM_SECONDS, hops: int = MAX_HOPS, share: float = FLUFF_SHARE) -> DataFrame:
    """states (tx, peer, stem_start, hops) with reason: why a transaction is broadcast now (timeout, hops or chance, the first that holds), null while its stem goes on; and expired: whether its state is as old as two stems."""
    age = now - F.col("stem_start")
    reason = F.when(age >= seconds, "timeout").when(F.col("hops") >= hops, "hops").when(draw(F.col("tx"), F.col("hops")) < share, "chance")
    return states.withColumn("reason", reason).withColumn("expired", age >= 2 * seconds)


def _states(ledger: Ledger) -> DataFrame:
    """Events as stems: an event's number is its transaction, its user the peer; a stem has up to three hops."""
    s = ledger["peer_samples"].select(F.col("event_id").alias("tx"), "peer", F.col("sec").alias("stem_start"), (F.col("event_id") % 4).alias("hops"))
    return s.join(F.broadcast(s.agg(F.max("stem_start").alias("now"))))


_DAY = 86400
_DECIDED = f"""SELECT tx, peer, CASE WHEN age >= {5 * _DAY} THEN 'timeout' WHEN hops >= {MAX_HOPS} THEN 'hops' WHEN ('0x' || substr(sha256(tx::VARCHAR || ':' || hops::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE < {FLUFF_SHARE}::DOUBLE THEN 'chance' END AS reason, age >= {10 * _DAY} AS expired
    FROM (SELECT event_id AS tx, peer, event_id % 4 AS hops, (SELECT max(sec) FROM peer_samples) - sec AS age FROM peer_samples)"""


@register("stem_decisions", _DECIDED)
def _decisions(ledger: Ledger) -> DataFrame:
    """Stems of at most five days, as events are days apart."""
    return stem_decisions(_states(ledger), F.col("now"), 5 * _DAY).select("tx", "peer", "reason", "expired")


@register("stem_stats", f"SELECT count(*) FILTER (NOT expired) AS stem_transactions, count(DISTINCT CASE WHEN reason IS NULL THEN peer END) AS active_stem_paths, count(*) FILTER (expired) AS expired FROM ({_DECIDED})")
def _stats(ledger: Ledger) -> DataFrame:
    """What is left after states as old as two stems went, and peers with a stem under way."""
    d = _decisions(ledger)
    return d.agg(F.count_if(~F.col("expired")).alias("stem_transactions"), F.countDistinct(F.when(F.col("reason").isNull(), F.col("peer"))).alias("active_stem_paths"), F.count_if("expired").alias("expired"))
