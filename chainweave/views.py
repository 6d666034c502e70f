"""The ledger's relations, as views of the order tables, and the same views as SQL for an independent engine.

An order is a transaction and its line items are its outputs; all orders of a date are a block. Shipped items (line status F) are spent
by a later transaction. The newest twentieth of the transactions is pending; the rest is confirmed.

Numbers that run over all orders are made of numbers within a date and sums over dates, so that no task sorts all rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Outputs shipped are spent by the transaction this many places later, plus the part's number modulo SPREAD.
SPEND_AFTER, SPREAD = 1, 16
#: Transactions from this share of the sequence on are pending.
POOL_FROM = 0.95
#: Bytes of an input, of an output and of a transaction without either.
INPUT_BYTES, OUTPUT_BYTES, BASE_BYTES = 148, 34, 10
#: Compact target of the first blocks, what a period takes off its mantissa, and the blocks of a period; after PERIODS periods it starts anew.
FIRST_BITS, HARDER, PERIOD, PERIODS = 0x1D00FFFF, 0x1111, 500, 15
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
LINE_COLUMNS = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def _txid(key: str) -> Column:
    return F.sha2(F.col(key).cast("string"), 256)


def _cents() -> Column:
    return F.round(F.col("l_extendedprice") * 100).cast("long")


class Ledger:
    """DataFrames of the relations over one directory of tables; each is planned when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet") if name in TABLES else getattr(self, name)()

    def seq_orders(self) -> DataFrame:
        """Orders with seq, from 1 by date and key, and height, from 0 by date. Dates, not orders, are numbered in one place."""
        orders = self["orders"]
        dates = orders.groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("n"))
        by_date = Window.orderBy("o_orderdate")
        before = F.coalesce(F.sum("n").over(by_date.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        dates = dates.select("o_orderdate", (F.row_number().over(by_date) - 1).cast("long").alias("height"), before.alias("before"), F.sum("n").over(Window.partitionBy()).alias("n_all"))
        place = F.row_number().over(Window.partitionBy("o_orderdate").orderBy("o_orderkey"))
        return orders.withColumn("place", place).join(dates, "o_orderdate").withColumn("seq", (F.col("before") + F.col("place")).cast("long")).drop("before")

    def blocks(self) -> DataFrame:
        dates = self["orders"].groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("n_tx"))
        h = (F.row_number().over(Window.orderBy("o_orderdate")) - 1).cast("long")
        hashed = lambda c: F.sha2(c.cast("string"), 256)
        b = dates.select(h.alias("height"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts"), "n_tx")
        bits = F.expr(f"{FIRST_BITS} - {HARDER} * (height div {PERIOD} % {PERIODS})").cast("long")
        return b.select("height", hashed(F.col("height")).alias("block_hash"), F.when(F.col("height") > 0, hashed(F.col("height") - 1)).alias("prev_hash"), "ts", "n_tx", bits.alias("bits"))

    def _seqs(self) -> DataFrame:
        """Transactions by order key and seq, without digests: what joins and counts go by."""
        last = F.floor(F.col("n_all") * POOL_FROM)
        return self.seq_orders().select(
            "o_orderkey", "height", (F.col("place") - 1).cast("long").alias("tx_index"), "seq", F.col("o_custkey").alias("custkey"),
            F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts"), (F.col("seq") > last).alias("pending"), last.alias("last_confirmed"),
        )

    def txs(self) -> DataFrame:
        return self._seqs().select(_txid("o_orderkey").alias("txid"), "height", "tx_index", "seq", "custkey", "ts", "pending", "o_orderkey")

    def _outputs(self) -> DataFrame:
        vout = (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_COLUMNS)) - 1).cast("long")
        lines = self["lineitem"].select("l_orderkey", vout.alias("vout"), _cents().alias("value"), F.col("l_suppkey").alias("address"), "l_linestatus", "l_partkey")
        return lines.join(self.txs().select(F.col("o_orderkey").alias("l_orderkey"), "txid", "height", "seq", "pending"), "l_orderkey")

    def tx_outputs(self) -> DataFrame:
        return self._outputs().select("txid", "height", "vout", "value", "address", "pending")

    def tx_inputs(self) -> DataFrame:
        spent = self._outputs().filter("l_linestatus = 'F'").select(F.col("txid").alias("prev_txid"), F.col("vout").alias("prev_vout"), (F.col("seq") + SPEND_AFTER + F.col("l_partkey") % SPREAD).alias("seq"))
        return spent.join(self.txs().select("seq", "txid", "height", "pending"), "seq").select("txid", "height", "prev_txid", "prev_vout", "pending")

    def utxos(self) -> DataFrame:
        spent = self.tx_inputs().select(F.col("prev_txid").alias("txid"), F.col("prev_vout").alias("vout"))
        return self.tx_outputs().select("txid", "vout", "value", "address", "height").join(spent, ["txid", "vout"], "left_anti")

    def utxo_ops(self) -> DataFrame:
        added = self.tx_outputs().select("txid", "vout", "height", F.lit("A").alias("op"))
        return added.unionByName(self.tx_inputs().select(F.col("prev_txid").alias("txid"), F.col("prev_vout").alias("vout"), "height", F.lit("D").alias("op")))

    def _spends(self, owners: DataFrame) -> DataFrame:
        """(o_orderkey, value, seq): items of these owners' orders that a later transaction, of number seq, spends."""
        lines = self["lineitem"].filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"), _cents().alias("value"), "l_partkey")
        return lines.join(owners.select("o_orderkey", "seq"), "o_orderkey").select("o_orderkey", "value", (F.col("seq") + SPEND_AFTER + F.col("l_partkey") % SPREAD).alias("seq"))

    def _fees(self, of: DataFrame, owners: DataFrame, lines: DataFrame) -> DataFrame:
        """Fees of the transactions `of`. An input's value is that of the item it spends, so that inputs are counted as items of their owners; digests come last."""
        outs = lines.select(F.col("l_orderkey").alias("o_orderkey"), _cents().alias("value")).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_out"), F.sum("value").alias("value_out"))
        ins = self._spends(owners).groupBy("seq").agg(F.count(F.lit(1)).alias("n_in"), F.sum("value").alias("value_in"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        t = of.select("o_orderkey", "height", "tx_index", "seq", "ts", "pending").join(outs, "o_orderkey", "left").join(ins, "seq", "left")
        t = t.select(_txid("o_orderkey").alias("txid"), "height", "tx_index", "seq", "ts", "pending", zero("n_in"), zero("n_out"), zero("value_in"), zero("value_out"))
        t = t.withColumn("fee", F.greatest(F.col("value_in") - F.col("value_out"), F.lit(0).cast("long"))).withColumn("vsize", F.expr(f"{INPUT_BYTES} * n_in + {OUTPUT_BYTES} * n_out + {BASE_BYTES}"))
        return t.withColumn("fee_rate", F.expr("1000 * fee div vsize"))

    def tx_fees(self) -> DataFrame:
        """(txid, n_in, n_out, value_in, value_out, fee, vsize, fee_rate) of every transaction; a fee is never below 0."""
        seqs = self._seqs()
        return self._fees(seqs, seqs, self["lineitem"])

    def mempool(self) -> DataFrame:
        """Fees of pending transactions, out of their own items and of those that so few places before them can spend; other items are never joined."""
        seqs = self._seqs()
        of = seqs.filter("pending")
        owners = seqs.filter(F.col("seq") > F.col("last_confirmed") - SPEND_AFTER - SPREAD)
        lines = self["lineitem"].join(of.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
        return self._fees(of, owners, lines).select("txid", F.col("seq").alias("added_seq"), F.col("ts").alias("added_at"), "n_in", "n_out", "fee", "vsize", "fee_rate")

    def pool_edges(self) -> DataFrame:
        """(parent, child) of pending transactions."""
        pool = self._seqs().filter("pending").select("o_orderkey", "seq")
        pairs = self._spends(pool).select(F.col("o_orderkey").alias("parent"), "seq").distinct().join(pool, "seq")
        return pairs.select(_txid("parent").alias("parent"), _txid("o_orderkey").alias("child"))

    def peer_samples(self) -> DataFrame:
        return self["events"].select(F.col("user_id").alias("peer"), "ts", F.col("event_type").alias("kind"), F.col("value").alias("amount"), "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"))


#: The same relations as common table expressions; each lists those it needs by naming them.
CTES = {
    "seq_orders": "SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq, dense_rank() OVER (ORDER BY o_orderdate) - 1 AS height, count(*) OVER () AS n_all FROM orders",
    "blocks": f"SELECT height, sha256(height::VARCHAR) AS block_hash, CASE WHEN height > 0 THEN sha256((height - 1)::VARCHAR) END AS prev_hash, epoch(min(o_orderdate))::BIGINT AS ts, count(*) AS n_tx, {FIRST_BITS}::BIGINT - {HARDER} * (height // {PERIOD} % {PERIODS}) AS bits FROM seq_orders GROUP BY height",
    "txs": f"SELECT sha256(o_orderkey::VARCHAR) AS txid, height, row_number() OVER (PARTITION BY height ORDER BY o_orderkey) - 1 AS tx_index, seq, o_custkey AS custkey, epoch(o_orderdate)::BIGINT AS ts, seq > floor(n_all * {POOL_FROM}::DOUBLE) AS pending, o_orderkey FROM seq_orders",
    "outputs_": f"SELECT txid, height, seq, pending, l_linestatus, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_COLUMNS)}) - 1 AS vout, round(l_extendedprice * 100)::BIGINT AS value, l_suppkey AS address FROM lineitem JOIN txs ON o_orderkey = l_orderkey",
    "tx_outputs": "SELECT txid, height, vout, value, address, pending FROM outputs_",
    "tx_inputs": f"SELECT t.txid, t.height, o.txid AS prev_txid, o.vout AS prev_vout, t.pending FROM outputs_ o JOIN txs t ON t.seq = o.seq + {SPEND_AFTER} + o.l_partkey % {SPREAD} WHERE o.l_linestatus = 'F'",
    "utxos": "SELECT o.txid, o.vout, o.value, o.address, o.height FROM tx_outputs o WHERE NOT EXISTS (SELECT 1 FROM tx_inputs i WHERE i.prev_txid = o.txid AND i.prev_vout = o.vout)",
    "utxo_ops": "SELECT txid, vout, height, 'A' AS op FROM tx_outputs UNION ALL SELECT prev_txid, prev_vout, height, 'D' FROM tx_inputs",
    "tx_fees": f"""SELECT *, 1000 * fee // vsize AS fee_rate FROM (SELECT *, greatest(value_in - value_out, 0) AS fee, {INPUT_BYTES} * n_in + {OUTPUT_BYTES} * n_out + {BASE_BYTES} AS vsize FROM (
      SELECT t.txid, t.height, t.tx_index, t.seq, t.ts, t.pending, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out, coalesce(i.v, 0)::BIGINT AS value_in, coalesce(o.v, 0)::BIGINT AS value_out FROM txs t
      LEFT JOIN (SELECT txid, count(*) AS n, sum(value) AS v FROM tx_outputs GROUP BY txid) o ON o.txid = t.txid
      LEFT JOIN (SELECT x.txid, count(*) AS n, sum(coalesce(p.value, 0)) AS v FROM tx_inputs x LEFT JOIN tx_outputs p ON p.txid = x.prev_txid AND p.vout = x.prev_vout GROUP BY x.txid) i ON i.txid = t.txid))""",
    "mempool": "SELECT txid, seq AS added_seq, ts AS added_at, n_in, n_out, fee, vsize, fee_rate FROM tx_fees WHERE pending",
    "pool_edges": "SELECT DISTINCT i.prev_txid AS parent, i.txid AS child FROM tx_inputs i JOIN txs p ON p.txid = i.prev_txid WHERE i.pending AND p.pending",
    "peer_samples": "SELECT user_id AS peer, ts, event_type AS kind, value AS amount, event_id, floor(epoch(ts))::BIGINT AS sec FROM events",
}
RELATIONS = tuple(CTES)


@lru_cache(maxsize=None)
def _needs(text: str) -> tuple[str, ...]:
    """Relations that a statement names, those they need first."""
    out: list[str] = []
    for name in CTES:
        if re.search(rf"\b{name}\b", text):
            out += [n for n in (*_needs(CTES[name]), name) if n not in out]
    return tuple(out)


def with_views(sql: str) -> str:
    """A statement over the relations, with those it needs as common table expressions in front."""
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in _needs(sql))
    if not own:
        return f"WITH {ctes}\n{sql}" if ctes else sql
    return f"WITH {own[1] or ''}{ctes + ',' if ctes else ''}\n{sql[own.end():]}"
