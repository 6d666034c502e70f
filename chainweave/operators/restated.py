"""SQL of its own for queries whose statement the other engine would else repeat.

Written from the base tables by other ways: transactions are joined by number instead of by digest, heights are places of dates, windows are joins or
closed forms, and groups are filtered aggregates. Two statements that agree so test what is asked, not only that engines agree on one text.
"""

from __future__ import annotations

from chainweave.registry import restate
from chainweave.views import BASE_BYTES, INPUT_BYTES, OUTPUT_BYTES, POOL_FROM, SPEND_AFTER, SPREAD

#: Transactions by number, their lines with the number of the transaction that spends them (null where none does), and days by place.
_SEQ = f"s AS (SELECT o_orderkey, o_orderdate, o_custkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq, (SELECT count(*) FROM orders) AS total FROM orders), q AS (SELECT *, seq > floor(total * {POOL_FROM}::DOUBLE) AS waits FROM s)"
_LINES = f"l AS (SELECT q.*, l_suppkey AS a, round(l_extendedprice * 100)::BIGINT AS v, CASE WHEN l_linestatus = 'F' AND seq + {SPEND_AFTER} + l_partkey % {SPREAD} <= total THEN seq + {SPEND_AFTER} + l_partkey % {SPREAD} END AS spender FROM lineitem JOIN q ON l_orderkey = o_orderkey)"
_FEES = f"""x AS (SELECT sha256(q.o_orderkey::VARCHAR) AS txid, q.*, coalesce(i.n, 0) AS ni, coalesce(o.n, 0) AS no, coalesce(i.v, 0)::BIGINT AS vi, coalesce(o.v, 0)::BIGINT AS vo FROM q
  LEFT JOIN (SELECT spender, count(*) AS n, sum(v) AS v FROM l WHERE spender IS NOT NULL GROUP BY spender) i ON i.spender = q.seq LEFT JOIN (SELECT seq, count(*) AS n, sum(v) AS v FROM l GROUP BY seq) o ON o.seq = q.seq),
y AS (SELECT *, CASE WHEN vi > vo THEN vi - vo ELSE 0 END AS paid, {INPUT_BYTES} * ni + {OUTPUT_BYTES} * no + {BASE_BYTES} AS bytes FROM x), f AS (SELECT *, 1000 * paid // bytes AS rate FROM y)"""
_DAYS = "d AS (SELECT o_orderdate AS day, epoch(o_orderdate)::BIGINT AS ts, count(*) AS n, (SELECT count(DISTINCT p.o_orderdate) FROM orders p) AS days FROM orders GROUP BY o_orderdate), h AS (SELECT *, rank() OVER (ORDER BY day) - 1 AS height FROM d)"
_EVENTS = "e AS (SELECT user_id AS peer, event_type AS kind, value AS amount, event_id, floor(epoch(ts))::BIGINT AS sec FROM events), z AS (SELECT max(sec) AS latest FROM e)"
_DIGITS = "CASE WHEN {0} = 0 THEN 0 ELSE floor(log10({0}))::BIGINT + 1 END"

CHAIN = {
    "block_count": "SELECT count(DISTINCT o_orderdate) AS n FROM orders",
    "best_block": "SELECT sha256((count(DISTINCT o_orderdate) - 1)::VARCHAR) AS block_hash, count(DISTINCT o_orderdate) - 1 AS height FROM orders",
    "recovered_tip": "SELECT sha256((count(DISTINCT o_orderdate) - 1)::VARCHAR) AS block_hash, count(DISTINCT o_orderdate) - 1 AS height, epoch(max(o_orderdate))::BIGINT AS ts FROM orders",
    "blocks_with_gap": "SELECT i - 1 AS height, i + 1 AS nxt FROM (SELECT unnest(range(1, (SELECT count(DISTINCT o_orderdate) - 1 FROM orders))) AS i) WHERE i % 97 = 5",
    "out_of_order_prefix": "SELECT least(699, count(DISTINCT o_orderdate) - 1) AS contiguous FROM orders",
    "confirmations": f"WITH {_DAYS} SELECT height, days - height AS confirmations FROM h",
    "kept_heights": f"WITH {_DAYS} SELECT height, sha256(height::VARCHAR) AS block_hash FROM h ORDER BY day DESC LIMIT 145",
    "recent_headers": f"WITH {_DAYS} SELECT height, sha256(height::VARCHAR) AS block_hash, ts FROM h ORDER BY day DESC LIMIT 11",
    "chain_tx_stats": "WITH w AS (SELECT DISTINCT o_orderdate AS day FROM orders ORDER BY day DESC LIMIT 144) SELECT count(DISTINCT o_orderdate) AS window_blocks, count(*) AS window_txs, (epoch(max(o_orderdate)) - epoch(min(o_orderdate)))::BIGINT AS window_seconds, round(count(*)::DOUBLE / greatest(epoch(max(o_orderdate)) - epoch(min(o_orderdate)), 1), 9) AS tx_rate, (SELECT count(*) FROM orders) AS txcount FROM orders SEMI JOIN w ON day = o_orderdate",
    "hashrate_by_height": f"WITH {_DAYS} SELECT a.height, count(*) AS n, any_value(a.ts) - min(b.ts) AS seconds FROM h a JOIN h b ON b.height BETWEEN a.height - 143 AND a.height GROUP BY a.height",
    "linkage_check": f"WITH {_DAYS} SELECT a.height, sha256((a.height - 1)::VARCHAR) = sha256(b.height::VARCHAR) AS linked FROM h a JOIN h b ON b.height = a.height - 1 WHERE b.height >= a.days - 1 - 288",
    "retarget_periods": f"WITH {_DAYS}, p AS (SELECT height // 144 AS period, list(ts ORDER BY day) AS t FROM h GROUP BY 1) SELECT period, len(t) AS n, t[-1] - t[1] AS seconds, round((t[-1] - t[1])::DOUBLE / 85800.0, 9) AS ratio FROM p",
    "height_chunks": "WITH m AS (SELECT count(DISTINCT o_orderdate) - 1 AS top FROM orders) SELECT c AS chunk, 128 * c AS first, least(128 * c + 127, top) AS last, c % 8 AS peer FROM m, unnest(range(top // 128 + 1)) AS u(c)",
    "shard_floor": "WITH m AS (SELECT least(499, count(DISTINCT o_orderdate) - 1) AS top FROM orders) SELECT CASE WHEN top < 7 THEN 0 ELSE top - 7 END AS floor FROM m",
    "same_block_spends": f"WITH {_SEQ}, {_LINES}, {_DAYS} SELECT h.height, count(*) AS n FROM l JOIN q b ON b.seq = l.spender AND b.o_orderdate = l.o_orderdate JOIN h ON h.day = b.o_orderdate GROUP BY h.height",
}
SET = {
    "utxo_count": f"WITH {_SEQ}, {_LINES} SELECT count(*) - count(spender) AS n FROM l",
    "utxo_total_value": f"WITH {_SEQ}, {_LINES} SELECT (sum(v) - coalesce(sum(v) FILTER (spender IS NOT NULL), 0))::BIGINT AS total FROM l",
    "txoutset_info": f"WITH {_SEQ}, {_LINES}, u AS (SELECT * FROM l WHERE spender IS NULL) SELECT (SELECT count(DISTINCT o_orderdate) - 1 FROM orders) AS height, count(*) AS txouts, count(DISTINCT o_orderkey) AS transactions, sum(v)::BIGINT AS total_amount, sum(180)::BIGINT AS bogosize, count(DISTINCT a) AS addresses FROM u",
    "address_info": f"WITH {_SEQ}, {_LINES} SELECT a AS address, count(*) AS n_outputs, sum(v)::BIGINT AS received, coalesce(sum(v) FILTER (spender IS NULL), 0)::BIGINT AS balance, coalesce(sum(v) FILTER (spender IS NOT NULL), 0)::BIGINT AS sent FROM l GROUP BY a",
    "address_received": "SELECT l_suppkey AS address, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS received FROM lineitem GROUP BY l_suppkey",
    "address_index": "WITH t AS (SELECT l_suppkey AS a, sha256(l_orderkey::VARCHAR) AS t, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_orderkey) SELECT a AS address, count(*) AS n_txs, sum(n)::BIGINT AS n_outputs, list_min(list(t)) AS first_txid, list_max(list(t)) AS last_txid FROM t GROUP BY a",
    "value_index": f"WITH t AS (SELECT l_orderkey, 1000 * {_DIGITS.format('round(l_extendedprice * 100)::BIGINT')} AS bucket, count(*) AS n FROM lineitem GROUP BY ALL) SELECT bucket, sum(n)::BIGINT AS n_outputs, count(*) AS n_txs FROM t GROUP BY bucket",
    "index_stats": f"SELECT (SELECT count(*) FROM orders) AS n_txs, (SELECT count(DISTINCT o_orderdate) FROM orders) AS n_blocks, (SELECT count(*) FROM (SELECT DISTINCT l_suppkey FROM lineitem)) AS n_addresses, count(*) AS n_outputs, count(DISTINCT {_DIGITS.format('round(l_extendedprice * 100)::BIGINT')}) AS n_buckets FROM lineitem",
}
POOL = {
    "tx_fees": f"WITH {_SEQ}, {_LINES}, {_FEES} SELECT txid, ni AS n_in, no AS n_out, vi AS value_in, vo AS value_out, paid AS fee, bytes AS vsize, rate AS fee_rate FROM f",
    "mempool_size": f"SELECT count(*) - floor(count(*) * {POOL_FROM}::DOUBLE)::BIGINT AS n FROM orders",
    "mempool_info": f"WITH {_SEQ}, {_LINES}, {_FEES} SELECT count(*) FILTER (waits) AS size, sum(bytes) FILTER (waits)::BIGINT AS bytes, (sum(250) FILTER (waits))::BIGINT AS bytes_estimate, sum(paid) FILTER (waits)::BIGINT AS total_fee FROM f",
    "raw_mempool_verbose": f"WITH {_SEQ}, {_LINES}, {_FEES} SELECT txid, paid AS fee, bytes AS vsize, rate AS fee_rate, epoch(o_orderdate)::BIGINT AS added_at, seq AS added_seq FROM f WHERE waits",
    "fee_histogram": f"WITH {_SEQ}, {_LINES}, {_FEES} SELECT {_DIGITS.format('rate')} AS digits, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM f WHERE waits GROUP BY 1",
    "prioritized_transactions": f"WITH {_SEQ}, {_LINES}, {_FEES} SELECT txid, rate AS fee_rate, seq AS added_seq FROM f WHERE waits QUALIFY row_number() OVER (ORDER BY rate DESC, seq) <= 100",
    "congestion_metrics": f"WITH {_SEQ}, {_LINES}, {_FEES}, c AS (SELECT count(*) AS n, sum(rate)::DOUBLE / count(*) AS r FROM f WHERE waits) SELECT n AS mempool_size, 1 + least(n // 1000, 10) AS avg_fee_heuristic, round(r, 6) AS avg_fee_rate, greatest(1, n // 2000) AS estimated_blocks, ['low', 'medium', 'high', 'critical'][1 + (n >= 1000)::INT + (n >= 5000)::INT + (n >= 20000)::INT] AS level FROM c",
    "block_stats": f"""WITH {_SEQ}, {_LINES}, {_FEES}, {_DAYS}, b AS (SELECT o_orderdate, sum(ni) AS ins, sum(no) AS outs, sum(vo) AS vo, sum(paid) AS paid, sum(bytes) AS bytes, min(paid) AS p0, max(paid) AS p1, min(rate) AS r0, max(rate) AS r1 FROM f GROUP BY o_orderdate)
      SELECT height, sha256(height::VARCHAR) AS block_hash, ts, n AS n_tx, ins::BIGINT AS ins, outs::BIGINT AS outs, vo::BIGINT AS total_out, paid::BIGINT AS total_fee, bytes::BIGINT AS size, p0 AS min_fee, p1 AS max_fee, r0 AS min_fee_rate, r1 AS max_fee_rate, 5000000000 >> (height // 210000) AS subsidy FROM h JOIN b ON o_orderdate = day""",
}
PEERS = {
    "peer_info": f"WITH {_EVENTS}, k AS (SELECT peer, kind, count(*) AS n, min(sec) AS lo, max(sec) AS hi FROM e GROUP BY peer, kind) SELECT peer, sum(n)::BIGINT AS messages, min(lo) AS first_seen, max(hi) AS last_seen, count(*) AS kinds FROM k GROUP BY peer",
    "connection_count": f"WITH {_EVENTS} SELECT count(*) AS n FROM (SELECT peer FROM e, z GROUP BY peer HAVING max(sec) > any_value(latest) - 86400)",
    "idle_peers": f"WITH {_EVENTS} SELECT peer, sec AS last_seen FROM e, z WHERE sec < latest - 7200 AND NOT EXISTS (SELECT 1 FROM e o WHERE o.peer = e.peer AND o.sec > e.sec) GROUP BY peer, sec",
    "auto_bans": f"WITH {_EVENTS} SELECT peer, count(*) FILTER (kind = 'error') AS violations FROM e GROUP BY peer HAVING count(*) FILTER (kind = 'error') >= 10",
    "listed_bans": f"WITH {_EVENTS} SELECT DISTINCT peer, sec + 86400 AS until FROM e, z WHERE kind = 'error' AND sec + 86400 > latest QUALIFY rank() OVER (PARTITION BY peer ORDER BY sec DESC) = 1",
    "replayed_messages": f"WITH {_EVENTS} SELECT DISTINCT a.event_id, a.peer, a.kind, a.sec FROM e a JOIN e b ON b.peer = a.peer AND b.kind = a.kind AND (b.sec < a.sec OR (b.sec = a.sec AND b.event_id < a.event_id)) AND a.sec - b.sec < 600",
    "trust_counts": f"WITH {_EVENTS}, t AS (SELECT CASE WHEN count(*) >= 100 THEN 2 WHEN count(*) >= 50 THEN 1 ELSE 0 END AS level FROM e GROUP BY peer) SELECT count(*) FILTER (level = 2) AS trusted, count(*) FILTER (level = 1) AS known, count(*) FILTER (level = 0) AS fresh, count(*) AS total FROM t",
    "net_totals": f"WITH {_EVENTS}, t AS (SELECT round(amount * 100)::BIGINT AS v, kind IN ('view', 'click') AS ours FROM e) SELECT coalesce(sum(v) FILTER (ours), 0)::BIGINT AS received, coalesce(sum(v) FILTER (NOT ours), 0)::BIGINT AS sent, count(*) AS messages FROM t",
    "dos_detected": f"WITH {_EVENTS} SELECT kind, count(*) AS n, count(*) / (sum(count(*)) OVER ()) > 0.2 AS attack FROM e GROUP BY kind",
    "relay_stats": f"WITH {_EVENTS} SELECT (SELECT count(*) FROM e, z WHERE latest - sec < 3600) AS recent_txs, (SELECT count(*) FROM (SELECT DISTINCT peer FROM e, z WHERE latest - sec < 86400)) AS recent_peers, count(*) AS total FROM e",
    "audit_log_tail": f"WITH {_EVENTS} SELECT event_id, peer, kind, sec FROM e QUALIFY row_number() OVER (ORDER BY sec DESC, event_id DESC) <= 50",
    "latest_metrics": f"WITH {_EVENTS} SELECT peer, kind, event_id AS last_event, sec FROM e QUALIFY row_number() OVER (PARTITION BY peer, kind ORDER BY sec DESC, event_id DESC) = 1",
    "valid_timestamps": f"WITH {_EVENTS} SELECT event_id, latest - sec <= 86400 AS valid FROM e, z",
    "pool_after_exit": "WITH t AS (SELECT l_suppkey AS p, l_linestatus = 'O' AS gains, sum(round(l_extendedprice * 100)::BIGINT) AS v FROM lineitem GROUP BY ALL) SELECT p AS participant, CASE WHEN sum(v) FILTER (gains) > coalesce(sum(v) FILTER (NOT gains), 0) THEN sum(v) FILTER (gains) - coalesce(sum(v) FILTER (NOT gains), 0) ELSE 0 END::BIGINT AS balance FROM t GROUP BY p",
}

for _name, _sql in (CHAIN | SET | POOL | PEERS).items():
    restate(_name, _sql)
