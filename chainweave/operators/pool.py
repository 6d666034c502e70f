"""Admission to the pending pool, replacement and package checks, as rule columns of which the first that fails decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweave.functions.hashing import active_rules
from chainweave.registry import register, register_sql
from chainweave.views import Ledger

#: Replacement presets: factor by which the rate must rise (in hundredths), fee that must be added, seconds between replacements and replacements at most.
PRESETS = {"disabled": None, "conservative": (200, 5000, 300, 3), "standard": (110, 1000, 60, 10), "aggressive": (105, 500, 0, 1_000_000)}


def first_failure(rules: dict[str, Column], passed: str = "accepted") -> Column:
    """Name of the first rule whose column is true."""
    out = None
    for name, test in rules.items():
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit(passed))


def admission(candidates: DataFrame, min_rate: int = 1000, min_fee: int = 1000) -> DataFrame:
    """candidates (txid, n_in, n_out, fee, fee_rate, known, conflicts) with verdict, by the rules in their order."""
    rules = {
        "duplicate": F.col("known"),
        "no inputs": F.col("n_in") == 0,
        "no outputs": F.col("n_out") == 0,
        "below relay rate": F.col("fee_rate") < min_rate,
        "below minimum fee": F.col("fee") < min_fee,
        "too many conflicts": F.col("conflicts") > 100,
    }
    return candidates.withColumn("verdict", first_failure(rules))


_CASES = "CASE WHEN t.known THEN 'duplicate' WHEN n_in = 0 THEN 'no inputs' WHEN n_out = 0 THEN 'no outputs' WHEN fee_rate < 1000 THEN 'below relay rate' WHEN fee < 1000 THEN 'below minimum fee' WHEN conflicts > 100 THEN 'too many conflicts' ELSE 'accepted' END"


@register(
    "mempool_admission",
    f"""SELECT txid, {_CASES} AS verdict FROM (SELECT m.txid, m.n_in, m.n_out, m.fee, m.fee_rate, m.added_seq % 10 = 0 AS known, coalesce(c.n, 0) AS conflicts FROM mempool m
    LEFT JOIN (SELECT i.txid, count(*) AS n FROM tx_inputs i JOIN tx_inputs j ON i.prev_txid = j.prev_txid AND i.prev_vout = j.prev_vout AND i.txid <> j.txid GROUP BY i.txid) c ON c.txid = m.txid) t""",
)
def _admission(ledger: Ledger) -> DataFrame:
    """Offers the pool again; a tenth of it is known already."""
    ins = ledger["tx_inputs"].select("txid", "prev_txid", "prev_vout")
    other = ins.select(F.col("txid").alias("other"), "prev_txid", "prev_vout")
    conflicts = ins.join(other, ["prev_txid", "prev_vout"]).filter("txid <> other").groupBy("txid").agg(F.count(F.lit(1)).alias("conflicts"))
    offered = ledger["mempool"].join(conflicts, "txid", "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0))).withColumn("known", F.col("added_seq") % 10 == 0)
    return admission(offered).select("txid", "verdict")


def replacement(pairs: DataFrame, mode: str) -> DataFrame:
    """pairs (old_fee, old_size, new_fee, new_size, replaced, age) with verdict under a preset. Products are decimals, so that none overflows."""
    preset = PRESETS[mode]
    if preset is None:
        return pairs.withColumn("verdict", F.lit("replacement is disabled"))
    factor, bump, cooldown, most = preset
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    rules = {
        "too many replacements": F.col("replaced") >= most,
        "too soon": F.col("age") < cooldown,
        "rate rises too little": wide("new_fee") * wide("old_size") * 100 <= wide("old_fee") * wide("new_size") * factor,
        "fee rises too little": F.col("new_fee") <= F.col("old_fee") + bump,
    }
    return pairs.withColumn("verdict", first_failure(rules, "replaces"))


_PAIR = "SELECT a.txid, b.txid AS new_txid, a.fee AS old_fee, a.vsize AS old_size, b.fee AS new_fee, b.vsize AS new_size, a.added_seq % 12 AS replaced, b.added_at - a.added_at AS age FROM mempool a JOIN mempool b ON b.added_seq = a.added_seq + 7"


@register(
    "replacement_verdicts",
    f"""SELECT txid, new_txid, CASE WHEN replaced >= 10 THEN 'too many replacements' WHEN age < 60 THEN 'too soon' WHEN new_fee::HUGEINT * old_size * 100 <= old_fee::HUGEINT * new_size * 110 THEN 'rate rises too little'
    WHEN new_fee <= old_fee + 1000 THEN 'fee rises too little' ELSE 'replaces' END AS verdict FROM ({_PAIR}) t""",
)
def _replacement(ledger: Ledger) -> DataFrame:
    """Each pending transaction against the seventh after it, under the standard preset."""
    m = ledger["mempool"]
    new = m.select(F.col("txid").alias("new_txid"), (F.col("added_seq") - 7).alias("added_seq"), F.col("fee").alias("new_fee"), F.col("vsize").alias("new_size"), F.col("added_at").alias("new_at"))
    pairs = m.join(new, "added_seq").select("txid", "new_txid", F.col("fee").alias("old_fee"), F.col("vsize").alias("old_size"), "new_fee", "new_size", (F.col("added_seq") % 12).alias("replaced"), (F.col("new_at") - F.col("added_at")).alias("age"))
    return replacement(pairs, "standard").select("txid", "new_txid", "verdict")


register_sql("mempool_size", "SELECT count(*) AS n FROM {mempool}")
register_sql("mempool_hashes", "SELECT txid FROM {mempool}")
register_sql("raw_mempool_verbose", "SELECT txid, fee, vsize, fee_rate, added_at, added_seq FROM {mempool}")
register_sql("transaction_sizes", "SELECT txid, 10 + 41 * n_in + 34 * n_out AS estimate, 10 + 37 * n_in + 34 * n_out AS index_size, 4 * (10 + 37 * n_in + 34 * n_out) AS weight, 148 * n_in + 34 * n_out + 10 AS template_size FROM {tx_fees}")
register_sql("fee_histogram", "SELECT CASE WHEN fee_rate = 0 THEN 0 ELSE length(CAST(fee_rate AS STRING)) END AS digits, count(*) AS n, CAST(sum(vsize) AS BIGINT) AS bytes FROM {mempool} GROUP BY CASE WHEN fee_rate = 0 THEN 0 ELSE length(CAST(fee_rate AS STRING)) END")
register_sql("accept_test", "SELECT txid, fee_rate >= 1000 AND n_in > 0 AND n_out > 0 AS allowed, 3 * (10 + 41 * n_in + 34 * n_out) + (10 + 41 * n_in + 34 * n_out) AS weight FROM {mempool}")
register_sql("match_expected_outputs", "SELECT o.txid FROM {tx_outputs} o JOIN (SELECT address, value FROM {tx_outputs} WHERE txid = (SELECT min(txid) FROM {tx_outputs})) e ON e.address = o.address AND e.value = o.value GROUP BY o.txid HAVING count(*) >= (SELECT count(*) FROM {tx_outputs} WHERE txid = (SELECT min(txid) FROM {tx_outputs}))")


@register("package_ids", "SELECT added_seq // 25 AS package, sha256(string_agg(txid, '' ORDER BY txid)) AS package_id FROM mempool GROUP BY added_seq // 25")
def _package_ids(ledger: Ledger) -> DataFrame:
    """A digest of a package's sorted ids; a package has at most 25."""
    ids = ledger["mempool"].groupBy(F.expr("added_seq div 25").alias("package")).agg(F.array_sort(F.collect_list("txid")).alias("ids"))
    return ids.select("package", F.sha2(F.array_join("ids", ""), 256).alias("package_id"))


#: Heights from which rules hold, scaled to the tables' chain.
RULES = {"heights": 100, "segments": 480, "taproot": 700}


@register("active_rules", "SELECT height, concat_ws(',', CASE WHEN height >= 100 THEN 'heights' END, CASE WHEN height >= 480 THEN 'segments' END, CASE WHEN height >= 700 THEN 'taproot' END) AS rules FROM blocks")
def _rules(ledger: Ledger) -> DataFrame:
    return ledger["blocks"].select("height", F.array_join(active_rules(F.col("height"), RULES), ",").alias("rules"))
