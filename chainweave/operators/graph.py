"""Graphs of the ledger: spends among pending transactions, and blocks with forks.

Descent in the block tree is found by pointer doubling: each round doubles the distance a block looks back, so that a chain of n
blocks takes log2(n) joins of the whole relation and no walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.functions.hashing import reversed_hex
from chainweave.plans.lineage import cut
from chainweave.registry import register, register_sql
from chainweave.views import Ledger

#: Ancestors, the transaction included, that policy allows.
MAX_ANCESTORS = 25


def ancestors(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(node, ancestor) of all generations over edges (parent, child). With a limit, nodes that have more ancestors than that are not followed any further: they have at least limit + 1 rows, the others all of theirs."""
    known = cut(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct(), "ancestors")
    frontier = known
    while not frontier.isEmpty():
        go_on = frontier
        if limit is not None:
            full = known.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("node")
            go_on = frontier.join(full, "node", "left_anti")
        further = go_on.join(edges, go_on["ancestor"] == edges["child"]).select("node", edges["parent"].alias("ancestor")).distinct()
        frontier = cut(further.join(known, ["node", "ancestor"], "left_anti"), "frontier")
        known = cut(known.unionByName(frontier), "ancestors")
    return known


def pruned_by_descent(blocks: DataFrame, marked: DataFrame) -> DataFrame:
    """blocks (block_hash, prev_hash, ...) with invalid: whether a block or any of its ancestors is in marked (block_hash)."""
    flags = blocks.select("block_hash", F.col("prev_hash").alias("at")).join(marked.select("block_hash", F.lit(True).alias("bad")).distinct(), "block_hash", "left")
    state = cut(flags.select("block_hash", "at", F.coalesce("bad", F.lit(False)).alias("bad")), "descent")
    while not state.filter("at IS NOT NULL AND NOT bad").isEmpty():
        up = state.select(F.col("block_hash").alias("at"), F.col("at").alias("next"), F.col("bad").alias("up_bad"))
        state = cut(state.join(up, "at", "left").select("block_hash", F.when(F.col("bad"), None).otherwise(F.col("next")).alias("at"), (F.col("bad") | F.coalesce("up_bad", F.lit(False))).alias("bad")), "descent")
    return blocks.join(state.select("block_hash", F.col("bad").alias("invalid")), "block_hash")


def forked(blocks: DataFrame) -> DataFrame:
    """The chain with a side branch of two blocks after every hundredth."""
    side = blocks.filter("height % 100 = 50")
    name = lambda k: F.sha2(F.concat(F.lit(f"fork{k}-"), F.col("height").cast("string")), 256)
    one = side.select((F.col("height") + 1).alias("height"), name(1).alias("block_hash"), F.col("block_hash").alias("prev_hash"))
    two = side.select((F.col("height") + 2).alias("height"), name(2).alias("block_hash"), name(1).alias("prev_hash"))
    return blocks.select("height", "block_hash", "prev_hash").unionByName(one).unionByName(two)


_FORKED = """forked AS (SELECT height, block_hash, prev_hash FROM blocks
    UNION ALL SELECT height + 1, sha256('fork1-' || height), block_hash FROM blocks WHERE height % 100 = 50
    UNION ALL SELECT height + 2, sha256('fork2-' || height), sha256('fork1-' || height) FROM blocks WHERE height % 100 = 50)"""


def chain_tips(blocks: DataFrame) -> DataFrame:
    """(block_hash, height, branch_length, status): blocks without a child; how far a branch is from the active chain, that of the highest tip (of equal ones, the smallest hash).

    Members of the active chain are found by doubling from its tip downwards, branches by how many of their own blocks a tip has.
    """
    tips = blocks.join(blocks.select(F.col("prev_hash").alias("block_hash")), "block_hash", "left_anti").select("block_hash", "height")
    best = tips.orderBy(F.desc("height"), "block_hash").limit(1)
    edges = blocks.select("block_hash", "prev_hash")
    # Pointers of all blocks to ancestors 2 ** k back; the set reached from the tip doubles with them.
    reached, jump = cut(best.select("block_hash"), "tip"), cut(edges.filter("prev_hash IS NOT NULL"), "jump")
    while not jump.isEmpty():
        more = reached.join(jump, "block_hash").select(F.col("prev_hash").alias("block_hash"))
        reached = cut(reached.unionByName(more).distinct(), "reached")
        back = jump.select(F.col("block_hash").alias("prev_hash"), F.col("prev_hash").alias("further"))
        jump = cut(jump.join(back, "prev_hash").select("block_hash", F.col("further").alias("prev_hash")), "jump")
    own = blocks.join(reached, "block_hash", "left_anti").select("block_hash", "prev_hash")
    # Branches are short next to the chain: walk them up from their tips, all at once.
    walk, length = tips.join(own, "block_hash").select(F.col("block_hash").alias("tip"), F.col("prev_hash").alias("at")).withColumn("n", F.lit(1)), None
    while True:
        walk = cut(walk, "branch")
        done = walk.join(own.select(F.col("block_hash").alias("at")), "at", "left_anti").select("tip", "n")
        length = done if length is None else length.unionByName(done)
        walk = walk.join(own.withColumnRenamed("block_hash", "at"), "at").select("tip", F.col("prev_hash").alias("at"), (F.col("n") + 1).alias("n"))
        if walk.isEmpty():
            break
    named = tips.join(length.withColumnRenamed("tip", "block_hash"), "block_hash", "left")
    return named.select("block_hash", "height", F.coalesce("n", F.lit(0)).cast("long").alias("branch_length"), F.when(F.col("n").isNull(), "active").otherwise("valid-fork").alias("status"))


@register(
    "chain_tips",
    f"WITH {_FORKED} SELECT f.block_hash, f.height, CASE WHEN f.height = (SELECT max(height) FROM forked) AND f.block_hash IN (SELECT block_hash FROM blocks) THEN 0 WHEN f.block_hash IN (SELECT block_hash FROM blocks) THEN -1 ELSE 2 END AS branch_length, CASE WHEN f.block_hash IN (SELECT block_hash FROM blocks) THEN 'active' ELSE 'valid-fork' END AS status FROM forked f WHERE NOT EXISTS (SELECT 1 FROM forked c WHERE c.prev_hash = f.block_hash)",
)
def _tips(ledger: Ledger) -> DataFrame:
    return chain_tips(forked(ledger["blocks"]))


@register(
    "invalidated_blocks",
    f"WITH {_FORKED} SELECT block_hash, height FROM forked WHERE (height >= 351 AND block_hash IN (SELECT block_hash FROM blocks)) OR (height > 400 AND block_hash NOT IN (SELECT block_hash FROM blocks))",
)
def _invalidated(ledger: Ledger) -> DataFrame:
    """Block 351 of the active chain is marked: it and all that follow it are invalid, and the branch that leaves the chain below it isn't."""
    chain = forked(ledger["blocks"])
    return pruned_by_descent(chain, ledger["blocks"].filter("height = 351").select("block_hash")).filter("invalid").select("block_hash", "height")


@register(
    "ancestor_limits",
    f"""WITH RECURSIVE closure(node, ancestor) AS (SELECT child, parent FROM pool_edges UNION SELECT c.node, e.parent FROM closure c JOIN pool_edges e ON e.child = c.ancestor)
    SELECT m.txid, count(c.ancestor) <= {MAX_ANCESTORS} AS within, CASE WHEN count(c.ancestor) <= {MAX_ANCESTORS} THEN count(c.ancestor) END AS n FROM mempool m LEFT JOIN closure c ON c.node = m.txid GROUP BY m.txid""",
)
def _limits(ledger: Ledger) -> DataFrame:
    found = ancestors(cut(ledger["pool_edges"], "edges"), MAX_ANCESTORS)
    counts = found.groupBy(F.col("node").alias("txid")).agg(F.count(F.lit(1)).alias("n"))
    within = F.coalesce("n", F.lit(0)) <= MAX_ANCESTORS
    return ledger["mempool"].select("txid").join(counts, "txid", "left").select("txid", within.alias("within"), F.when(within, F.coalesce("n", F.lit(0))).alias("n"))


def within_policy(edges: DataFrame, limit: int = MAX_ANCESTORS) -> DataFrame:
    """(node, ancestor) of all generations, for nodes of at most `limit` ancestors, as many as policy admits; ancestor_limits names those beyond."""
    found = ancestors(edges, limit)
    full = found.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("node")
    return found.join(full, "node", "left_anti")


_CLOSURE = """WITH RECURSIVE closure(node, ancestor) AS (SELECT child, parent FROM pool_edges UNION SELECT c.node, e.parent FROM closure c JOIN pool_edges e ON e.child = c.ancestor)
    SELECT {select} FROM closure WHERE {by} IN (SELECT {by} FROM closure GROUP BY {by} HAVING count(*) <= %d)""" % MAX_ANCESTORS


@register("pool_ancestors", _CLOSURE.format(select="node AS txid, ancestor", by="node"))
def _pool_ancestors(ledger: Ledger) -> DataFrame:
    return within_policy(cut(ledger["pool_edges"], "edges")).select(F.col("node").alias("txid"), "ancestor")


@register("pool_descendants", _CLOSURE.format(select="ancestor AS txid, node AS descendant", by="ancestor"))
def _pool_descendants(ledger: Ledger) -> DataFrame:
    """Ancestors over the same edges the other way round."""
    back = cut(ledger["pool_edges"].select(F.col("child").alias("parent"), F.col("parent").alias("child")), "edges")
    return within_policy(back).select(F.col("node").alias("txid"), F.col("ancestor").alias("descendant"))


def reconsidered(blocks: DataFrame, marked: DataFrame, block: DataFrame) -> DataFrame:
    """blocks with invalid, as after marks were taken off these blocks (block_hash) and all that descend from them; other marks stay."""
    below = pruned_by_descent(blocks, block).filter("invalid").select("block_hash")
    return pruned_by_descent(blocks, marked.join(below, "block_hash", "left_anti"))


@register(
    "reconsidered_blocks",
    "SELECT sha256('fork2-' || height) AS block_hash, height + 2 AS height FROM blocks WHERE height = 250",
)
def _reconsidered(ledger: Ledger) -> DataFrame:
    """Blocks 351 and 500 of the active chain and the end of the branch after 250 and of that after 450 are marked, then 351 is reconsidered: with it go the marks behind it, and only the branch that left before keeps its own."""
    chain = forked(ledger["blocks"])
    ends = chain.filter("height IN (252, 452)").join(ledger["blocks"].select("block_hash"), "block_hash", "left_anti").select("block_hash")
    marked = ledger["blocks"].filter("height IN (351, 500)").select("block_hash").unionByName(ends)
    return reconsidered(chain, marked, ledger["blocks"].filter("height = 351").select("block_hash")).filter("invalid").select("block_hash", "height")


register_sql("pool_edges", "SELECT parent, child FROM {pool_edges}")
register_sql("pool_parents", "SELECT e.child AS txid, m.txid AS parent, m.fee, m.vsize FROM {pool_edges} e JOIN {mempool} m ON m.txid = e.parent")
register_sql("pool_children", "SELECT e.parent AS txid, m.txid AS child, m.fee, m.vsize FROM {pool_edges} e JOIN {mempool} m ON m.txid = e.child")
register_sql("effective_includes", "SELECT e.parent AS txid FROM {pool_edges} e WHERE e.child = (SELECT max(child) FROM {pool_edges})")
register_sql(
    "pool_two_generations",
    "SELECT txid, count(DISTINCT ancestor) AS n FROM (SELECT child AS txid, parent AS ancestor FROM {pool_edges} UNION ALL SELECT a.child AS txid, b.parent AS ancestor FROM {pool_edges} a JOIN {pool_edges} b ON b.child = a.parent) t GROUP BY txid",
)


def merkle_levels(block_txs: DataFrame) -> DataFrame:
    """(height, root) of blocks of (height, tx_index, txid): pairs of digests are hashed level by level, all blocks at once; the last of an odd level pairs with itself. Digests are in display order and hashed reversed, twice, as the chain does."""
    level = block_txs.select("height", F.col("tx_index").alias("i"), F.unhex(reversed_hex(F.col("txid"))).alias("d"))
    level = cut(level, "merkle")
    while not level.filter("i > 0").isEmpty():
        pairs = level.groupBy("height", F.expr("i div 2").alias("i")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("d"))).alias("a"), F.max(F.when(F.col("i") % 2 == 1, F.col("d"))).alias("b"))
        both = F.concat("a", F.coalesce("b", "a"))
        # A block of one digest is its own root already.
        sizes = level.groupBy("height").agg(F.max("i").alias("top"))
        once = F.unhex(F.sha2(both, 256))
        level = cut(pairs.join(sizes, "height").select("height", "i", F.when(F.col("top") == 0, F.col("a")).otherwise(F.unhex(F.sha2(once, 256))).alias("d")), "merkle")
    return level.select("height", F.lower(reversed_hex(F.hex("d"))).alias("root"))


@register("block_first_transactions", "SELECT height, max(CASE WHEN tx_index = 0 THEN txid END) AS first, count(*) AS n FROM txs GROUP BY height")
def _first_transactions(ledger: Ledger) -> DataFrame:
    """The transaction that stands first in each block, and how many the block has."""
    t = ledger["txs"]
    return t.groupBy("height").agg(F.max(F.when(F.col("tx_index") == 0, F.col("txid"))).alias("first"), F.count(F.lit(1)).alias("n"))


_REVERSED = "array_to_string(list_reverse(regexp_extract_all({}, '..')), '')"


@register(
    "merkle_roots",
    f"""WITH RECURSIVE m AS (SELECT height, list({_REVERSED.format('txid')} ORDER BY tx_index) AS l FROM txs GROUP BY height
    UNION ALL SELECT height, list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(unhex(sha256(unhex(l[2 * i + 1] || coalesce(l[2 * i + 2], l[2 * i + 1])))))) FROM m WHERE len(l) > 1)
    SELECT height, {_REVERSED.format('l[1]')} AS root FROM m WHERE len(l) = 1""",
)
def _merkle(ledger: Ledger) -> DataFrame:
    """The root over each block's transactions. The SQL reduces each block's list of digests by itself."""
    return merkle_levels(ledger["txs"])
