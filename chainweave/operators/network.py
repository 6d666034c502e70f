"""Peers, addresses, bans and limits: scores, merges and stateful counters in their batch form."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chainweave.registry import register, register_sql
from chainweave.views import Ledger

#: Addresses that count as local: private, loopback, link-local or unspecified.
LOCAL = r"^(0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^::1$|^fe[89ab][0-9a-f]:|^f[cd][0-9a-f]{2}:"


def is_local(ip: Column) -> Column:
    return F.coalesce(F.lower(ip).rlike(LOCAL), F.lit(False))


def ipv4_subnet(ip: Column) -> Column:
    return F.substring_index(ip, ".", 3)


def _addresses(ledger: Ledger) -> DataFrame:
    """An address for each customer."""
    k = F.col("c_custkey")
    ip = F.concat_ws(".", (F.when(k % 11 == 0, 10).when(k % 11 == 1, 192).otherwise(20 + k % 200)).cast("string"), (F.when(k % 11 == 1, 168).otherwise(k % 250)).cast("string"), (k % 13).cast("string"), (k % 251).cast("string"))
    return ledger["customer"].select(k.alias("id"), ip.alias("ip"), (k * 37 % 1000).alias("last_seen"), (k % 8).alias("services"))


_ADDR = "addr AS (SELECT c_custkey AS id, concat_ws('.', CASE WHEN c_custkey % 11 = 0 THEN 10 WHEN c_custkey % 11 = 1 THEN 192 ELSE 20 + c_custkey % 200 END, CASE WHEN c_custkey % 11 = 1 THEN 168 ELSE c_custkey % 250 END, c_custkey % 13, c_custkey % 251) AS ip, c_custkey * 37 % 1000 AS last_seen, c_custkey % 8 AS services FROM customer)"
_LOCAL = "(ip LIKE '10.%' OR ip LIKE '127.%' OR ip LIKE '192.168.%' OR ip LIKE '169.254.%' OR ip LIKE '0.%' OR (ip LIKE '172.%' AND split_part(ip, '.', 2)::INT BETWEEN 16 AND 31))"


def usable_addresses(addresses: DataFrame, bans: DataFrame, connected: DataFrame, now: int) -> DataFrame:
    """Addresses that aren't local, banned (until later than now; null: for good) or connected."""
    banned = bans.filter(F.col("until").isNull() | (F.col("until") > now)).select("ip")
    return addresses.filter(~is_local(F.col("ip"))).join(banned, "ip", "left_anti").join(connected.select("ip"), "ip", "left_anti")


@register("usable_addresses", f"WITH {_ADDR} SELECT id, ip FROM addr WHERE NOT {_LOCAL} AND ip NOT IN (SELECT ip FROM addr WHERE id % 17 = 0) AND ip NOT IN (SELECT ip FROM addr WHERE id % 19 = 0)")
def _usable(ledger: Ledger) -> DataFrame:
    a = _addresses(ledger)
    bans = a.filter("id % 17 = 0").select("ip", F.lit(5000).alias("until"))
    return usable_addresses(a, bans, a.filter("id % 19 = 0"), 1000).select("id", "ip")


@register("address_is_local", f"WITH {_ADDR} SELECT id, ip, {_LOCAL} AS is_local, regexp_replace(ip, '\\.[0-9]+$', '') AS subnet FROM addr")
def _local(ledger: Ledger) -> DataFrame:
    return _addresses(ledger).select("id", "ip", is_local(F.col("ip")).alias("is_local"), ipv4_subnet(F.col("ip")).alias("subnet"))


@register("fresh_addresses", f"WITH {_ADDR} SELECT id, ip, last_seen FROM addr WHERE last_seen >= 500 ORDER BY last_seen DESC, id LIMIT 100")
def _fresh(ledger: Ledger) -> DataFrame:
    return _addresses(ledger).filter("last_seen >= 500").orderBy(F.desc("last_seen"), "id").limit(100).select("id", "ip", "last_seen")


@register("expired_addresses", f"WITH {_ADDR} SELECT id FROM addr WHERE last_seen < 500")
def _expired(ledger: Ledger) -> DataFrame:
    return _addresses(ledger).filter("last_seen < 500").select("id")


@register("address_eviction_order", f"WITH {_ADDR} SELECT id, last_seen FROM addr ORDER BY last_seen, id LIMIT 50")
def _evicted(ledger: Ledger) -> DataFrame:
    """What leaves first when the address book is full."""
    return _addresses(ledger).orderBy("last_seen", "id").limit(50).select("id", "last_seen")


@register("node_addresses", f"WITH {_ADDR} SELECT id, ip, services FROM addr ORDER BY id LIMIT 100")
def _node_addresses(ledger: Ledger) -> DataFrame:
    return _addresses(ledger).orderBy("id").limit(100).select("id", "ip", "services")


@register("added_node_info", f"WITH {_ADDR} SELECT a.id, a.ip, c.ip IS NOT NULL AS connected FROM addr a LEFT JOIN (SELECT DISTINCT ip FROM addr WHERE id % 3 = 0) c ON c.ip = a.ip")
def _added(ledger: Ledger) -> DataFrame:
    a = _addresses(ledger)
    connected = a.filter("id % 3 = 0").select("ip", F.lit(True).alias("on")).distinct()
    return a.join(connected, "ip", "left").select("id", "ip", F.coalesce("on", F.lit(False)).alias("connected"))


def merge_bans(lists: DataFrame) -> DataFrame:
    """(addr, until, reasons) of entries (addr, until, reason, source): a permanent ban (null) wins, else the latest; reasons in order of their sources, joined by '; '."""
    reasons = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "reason"))), lambda s: s["reason"]), "; ")
    return lists.groupBy("addr").agg(F.when(F.max(F.col("until").isNull()), None).otherwise(F.max("until")).alias("until"), reasons.alias("reasons"))


_BANS = "SELECT o_custkey AS addr, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE epoch(o_orderdate)::BIGINT END AS until, o_orderstatus AS reason, o_orderkey AS source FROM orders"


@register("merged_bans", f"SELECT addr, CASE WHEN count(*) FILTER (until IS NULL) > 0 THEN NULL ELSE max(until) END AS until, string_agg(reason, '; ' ORDER BY source, reason) AS reasons FROM ({_BANS}) t GROUP BY addr")
def _merged(ledger: Ledger) -> DataFrame:
    o = ledger["orders"]
    until = F.when(F.col("o_orderpriority") == "1-URGENT", None).otherwise(F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    return merge_bans(o.select(F.col("o_custkey").alias("addr"), until.alias("until"), F.col("o_orderstatus").alias("reason"), F.col("o_orderkey").alias("source")))


register_sql("listed_bans", "SELECT peer, max(sec) + 86400 AS until FROM {peer_samples} WHERE kind = 'error' GROUP BY peer HAVING max(sec) + 86400 > (SELECT max(sec) FROM {peer_samples})")


def peer_score(blocks: Column, lan: Column, latency: Column, bandwidth: Column, failures: Column, recency: Column) -> Column:
    """A peer without blocks scores 3 on a local network, else by latency; others by bandwidth, failures, recency and latency, three times as much on a local network, at least 0.1."""
    new = F.when(lan, F.lit(3.0)).otherwise(F.least(F.lit(1000.0) / F.greatest(latency, F.lit(1.0)), F.lit(2.0)))
    known = F.greatest(bandwidth / 100000.0 - 0.1 * failures + recency - latency / 10000.0, F.lit(0.1))
    return F.when(blocks == 0, new).otherwise(F.when(lan, known * 3).otherwise(known))


_SCORE = "CASE WHEN blocks = 0 THEN CASE WHEN lan THEN 3.0::DOUBLE ELSE least(1000.0::DOUBLE / greatest(latency, 1.0::DOUBLE), 2.0::DOUBLE) END ELSE greatest(bandwidth / 100000.0::DOUBLE - 0.1::DOUBLE * failures + 0.5::DOUBLE - latency / 10000.0::DOUBLE, 0.1::DOUBLE) * CASE WHEN lan THEN 3 ELSE 1 END END"
_PEERS = "peers AS (SELECT peer, peer % 10 = 0 AS lan, count(*) FILTER (kind = 'purchase') AS blocks, count(*) FILTER (kind = 'error') AS failures, avg(round(amount * 100)) AS latency, coalesce(sum(CASE WHEN kind = 'view' THEN round(amount * 100000) END), 0) AS bandwidth FROM peer_samples GROUP BY peer)"


def _peers(ledger: Ledger) -> DataFrame:
    s = ledger["peer_samples"]
    p = s.groupBy("peer").agg(F.count_if(F.col("kind") == "purchase").alias("blocks"), F.count_if(F.col("kind") == "error").alias("failures"), F.avg(F.round(F.col("amount") * 100)).alias("latency"), F.coalesce(F.sum(F.when(F.col("kind") == "view", F.round(F.col("amount") * 100000))), F.lit(0.0)).alias("bandwidth"))
    p = p.withColumn("lan", F.col("peer") % 10 == 0)
    return p.withColumn("score", F.round(peer_score(F.col("blocks"), F.col("lan"), F.col("latency"), F.col("bandwidth"), F.col("failures"), F.lit(0.5)), 6))


@register("peer_scores", f"WITH {_PEERS} SELECT peer, blocks, failures, lan, round({_SCORE}, 6) AS score FROM peers")
def _scores(ledger: Ledger) -> DataFrame:
    return _peers(ledger).select("peer", "blocks", "failures", "lan", "score")


@register("best_peers", f"WITH {_PEERS} SELECT a.peer, coalesce(round({_SCORE}, 6), 1.0) AS score FROM (SELECT i AS peer FROM range(0, 400, 3) r(i)) a LEFT JOIN peers USING (peer) ORDER BY score DESC, a.peer LIMIT 20")
def _best(ledger: Ledger) -> DataFrame:
    """The best of the available peers; unknown ones score 1."""
    available = ledger.spark.range(0, 400, 3).select(F.col("id").alias("peer"))
    return available.join(_peers(ledger).select("peer", "score"), "peer", "left").select("peer", F.coalesce("score", F.lit(1.0)).alias("score")).orderBy(F.desc("score"), "peer").limit(20)


register_sql("peer_info", "SELECT peer, count(*) AS messages, min(sec) AS first_seen, max(sec) AS last_seen, count(DISTINCT kind) AS kinds FROM {peer_samples} GROUP BY peer")
register_sql("connection_count", "SELECT count(DISTINCT peer) AS n FROM {peer_samples} WHERE sec > (SELECT max(sec) FROM {peer_samples}) - 86400")


def _fold(rows: DataFrame, step: Callable[[], Callable[..., tuple]], fields: list[str], schema: str) -> DataFrame:
    """(key, at, id and what step gives) of rows (key and fields), each key's in order of at and id.

    step() starts a key: it gives the function that takes the row's fields in turn. Rows stream through a sort, so that a key of any number of rows takes the memory of a batch and of what its function keeps; a null key is a key.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, take = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", *fields)]
            out = []
            for k, *values in zip(*columns, strict=True):
                if take is None or k != key:
                    key, take = k, step()
                out.append((k, values[0], values[1], *take(*values)))
            made = zip(*out, strict=True) if out else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, arrow, strict=True)], schema=arrow)

    return rows.select("key", *fields).repartition("key").sortWithinPartitions("key", "at", "id").mapInArrow(run, schema)


def sliding_log(attempts: DataFrame, window: int, most: int) -> DataFrame:
    """(key, at, id) with accepted: an attempt is accepted if fewer than `most` accepted ones lie in (at - window, at]; rejected ones don't count.

    Acceptance depends on what was accepted before, so a key's attempts are folded in order, with the accepted times of the window as state. Attempts without a time are rejected. Repeated rows are attempts of their own; an empty table gives an empty one.
    """

    def start() -> Callable[..., tuple]:
        log: deque[int] = deque()

        def take(at: int | None, _: int) -> tuple:
            if at is None:
                return (False,)
            while log and log[0] <= at - window:
                log.popleft()
            if len(log) < most:
                log.append(at)
                return (True,)
            return (False,)

        return take

    return _fold(attempts, start, ["at", "id"], "key bigint, at bigint, id bigint, accepted boolean")


#: A fold in SQL: every step takes the next attempt of each peer.
_LIVE = "list_filter(f.log, lambda t: t > s.sec - 43200)"
LIMITED = f"""WITH RECURSIVE s AS (SELECT peer, sec, event_id, row_number() OVER (PARTITION BY peer ORDER BY sec, event_id) AS n FROM peer_samples),
    f AS (SELECT peer, sec, event_id, n, [sec] AS log, true AS accepted FROM s WHERE n = 1
      UNION ALL SELECT s.peer, s.sec, s.event_id, s.n, CASE WHEN len({_LIVE}) < 3 THEN list_append({_LIVE}, s.sec) ELSE {_LIVE} END, len({_LIVE}) < 3 FROM f JOIN s ON s.peer = f.peer AND s.n = f.n + 1)
    SELECT peer AS key, sec AS at, event_id AS id, accepted FROM f"""


@register("connection_limiter", LIMITED)
def _limiter(ledger: Ledger) -> DataFrame:
    """At most 3 connections a peer in 12 hours."""
    return sliding_log(ledger["peer_samples"].select(F.col("peer").alias("key"), F.col("sec").alias("at"), F.col("event_id").alias("id")), 43200, 3)


register_sql("auto_bans", "SELECT peer, count(*) AS violations FROM {peer_samples} WHERE kind = 'error' GROUP BY peer HAVING count(*) >= 10")


def reset_windows(samples: DataFrame, length: int) -> DataFrame:
    """(key, at, id, amount) with start and used: a window opens at the first sample after the last one's end, and sums amounts until it ends; it is neither aligned nor sliding.

    Samples without a time belong to no window: start and used are null. A null amount counts 0. Repeated rows count each; an empty table gives an empty one.
    """

    def start() -> Callable[..., tuple]:
        begin, used = None, 0

        def take(at: int | None, _: int, amount: int | None) -> tuple:
            nonlocal begin, used
            if at is None:
                return None, None
            if begin is None or at - begin >= length:
                begin, used = at, 0
            used += amount or 0
            return begin, used

        return take

    return _fold(samples, start, ["at", "id", "amount"], "key bigint, at bigint, id bigint, start bigint, used bigint")


_RESET = """WITH RECURSIVE s AS (SELECT peer, sec, event_id, round(amount * 100)::BIGINT AS v, row_number() OVER (PARTITION BY peer ORDER BY sec, event_id) AS n FROM peer_samples),
    f AS (SELECT peer, sec, event_id, n, sec AS start, v AS used FROM s WHERE n = 1
      UNION ALL SELECT s.peer, s.sec, s.event_id, s.n, CASE WHEN s.sec - f.start >= 86400 THEN s.sec ELSE f.start END, CASE WHEN s.sec - f.start >= 86400 THEN s.v ELSE f.used + s.v END FROM f JOIN s ON s.peer = f.peer AND s.n = f.n + 1)
    SELECT peer AS key, sec AS at, event_id AS id, start, used FROM f"""


@register("bandwidth_reset_windows", _RESET)
def _reset(ledger: Ledger) -> DataFrame:
    """Hundredths of amounts in windows of a day that open when the last has ended."""
    return reset_windows(ledger["peer_samples"].select(F.col("peer").alias("key"), F.col("sec").alias("at"), F.col("event_id").alias("id"), F.round(F.col("amount") * 100).cast("long").alias("amount")), 86400)


@register("bandwidth_aligned_windows", "SELECT scope, key, sec // 3600 * 3600 AS start, count(*) AS requests, sum(round(amount * 100))::BIGINT AS bytes FROM (SELECT unnest(['peer', 'subnet']) AS scope, unnest([peer, peer // 16]) AS key, sec, amount FROM peer_samples) t GROUP BY scope, key, sec // 3600 * 3600")
def _aligned(ledger: Ledger) -> DataFrame:
    """Bytes and requests an hour of every peer and of its subnet; each sample counts under either key."""
    keys = F.explode(F.array(F.struct(F.lit("peer").alias("scope"), F.col("peer").alias("key")), F.struct(F.lit("subnet").alias("scope"), F.expr("peer div 16").alias("key"))))
    rows = ledger["peer_samples"].select(keys.alias("k"), F.expr("sec div 3600 * 3600").alias("start"), F.round(F.col("amount") * 100).cast("long").alias("bytes"))
    return rows.groupBy("k.scope", "k.key", "start").agg(F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("bytes"))


register_sql("idle_peers", "SELECT peer, max(sec) AS last_seen FROM {peer_samples} GROUP BY peer HAVING max(sec) < (SELECT max(sec) FROM {peer_samples}) - 7200")
register_sql(
    "ibd_serving",
    "SELECT peer, n, reputation, CASE WHEN reputation < 0 THEN 'reputation' WHEN since < 600 THEN 'cooldown' WHEN n > 80 THEN 'limit' ELSE 'serve' END AS verdict FROM (SELECT peer, count(*) AS n, least(100, 100 - 10 * count_if(kind = 'error') + least((max(sec) - min(sec)) div 3600, 100)) AS reputation, (SELECT max(sec) FROM {peer_samples}) - max(sec) AS since FROM {peer_samples} GROUP BY peer) t",
)
register_sql("replayed_messages", "SELECT event_id, peer, kind, sec FROM (SELECT event_id, peer, kind, sec, sec - lag(sec) OVER (PARTITION BY peer, kind ORDER BY sec, event_id) AS gap FROM {peer_samples}) t WHERE gap < 600")
register_sql("valid_timestamps", "SELECT event_id, sec BETWEEN (SELECT max(sec) FROM {peer_samples}) - 86400 AND (SELECT max(sec) FROM {peer_samples}) + 300 AS valid FROM {peer_samples}")
register_sql("out_of_order_prefix", "SELECT max(height) AS contiguous FROM (SELECT height, row_number() OVER (ORDER BY height) - 1 AS r FROM {blocks} WHERE height <> 700) t WHERE height = r")
register_sql("shard_floor", "SELECT min(done) AS floor FROM (SELECT height % 8 AS shard, max(height) AS done FROM {blocks} WHERE height < 500 GROUP BY height % 8) t")
register_sql("dos_detected", "SELECT kind, count(*) AS n, count(*) * 5 > (SELECT count(*) FROM {peer_samples}) AS attack FROM {peer_samples} GROUP BY kind")
