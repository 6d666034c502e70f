"""Methods of the node's interfaces by the queries that answer them.

METHODS maps a method to registered queries, or to the name of a Python entry for sources, sinks and scalar functions; methods
that act on a process or on the network have no relational meaning and are listed in OUTSIDE. ROUTES maps web routes to methods.
"""

from __future__ import annotations

from chainweave import registry
from chainweave.views import Ledger

METHODS: dict[str, tuple[str, ...]] = {
    "getblockchaininfo": ("best_block", "median_time_past", "block_count"),
    "getblock": ("block_verbose",),
    "getblockhash": ("hash_by_height",),
    "getblockheader": ("block_headers_verbose", "median_time_past", "chainwork"),
    "getbestblockhash": ("best_block",),
    "getblockcount": ("best_block",),
    "getdifficulty": ("block_difficulty",),
    "gettxoutsetinfo": ("txoutset_info", "utxo_set_digest"),
    "loadtxoutset": ("sources.snapshot.read_snapshots",),
    "verifychain": ("linkage_check", "merkle_roots"),
    "getchaintips": ("chain_tips",),
    "getchaintxstats": ("chain_tx_stats",),
    "getblockstats": ("block_stats",),
    "pruneblockchain": ("pruned_blocks", "pruned_aggressively", "pruned_components"),
    "getpruneinfo": ("pruning_stats", "auto_prune_due"),
    "invalidateblock": ("invalidated_blocks",),
    "reconsiderblock": ("reconsidered_blocks",),
    "waitfornewblock": ("streaming.operators.event_stream",),
    "waitforblock": ("streaming.operators.event_stream",),
    "waitforblockheight": ("streaming.operators.event_stream",),
    "getrawtransaction": ("raw_transactions", "transaction_by_id"),
    "sendrawtransaction": ("mempool_admission",),
    "testmempoolaccept": ("accept_test", "package_verdicts"),
    "gettxout": ("gettxout",),
    "gettxoutproof": ("functions.wire.merkle_proof", "merkle_roots"),
    "verifytxoutproof": ("functions.wire.proof_root", "merkle_roots"),
    "getmempoolinfo": ("mempool_info",),
    "getrawmempool": ("mempool_hashes", "raw_mempool_verbose"),
    "savemempool": ("sources.snapshot.Tree",),
    "getmempoolancestors": ("pool_ancestors", "ancestor_limits"),
    "getmempooldescendants": ("pool_descendants", "pool_children"),
    "getmempoolentry": ("mempool_entries",),
    "getnetworkinfo": ("connection_count",),
    "getpeerinfo": ("peer_info", "peer_scores"),
    "getconnectioncount": ("connection_count",),
    "getnettotals": ("net_totals",),
    "clearbanned": ("sources.snapshot.Tree",),
    "setban": ("merged_bans",),
    "listbanned": ("listed_bans",),
    "getaddednodeinfo": ("added_node_info",),
    "getnodeaddresses": ("node_addresses",),
    "getmininginfo": ("network_hashrate", "hashrate_by_height"),
    "getblocktemplate": ("block_template",),
    "submitblock": ("utxo_ops_appended", "utxo_delta_applied"),
    "estimatesmartfee": ("smart_fee_estimate",),
    "getblockfilter": ("block_filters",),
    "getindexinfo": ("index_stats",),
    "getblockchainstate": ("best_block", "median_time_past"),
    "validateaddress": ("functions.hashing.address_kind",),
    "getaddressinfo": ("address_info",),
    "gettransactiondetails": ("transaction_details",),
    "gethealth": ("health_report",),
    "getmetrics": ("node_metrics", "latest_metrics"),
    "createpaymentrequest": ("payment_states",),
    "getpaymentstate": ("payment_states",),
    "listpayments": ("payment_states", "payments_by_state"),
    "createvault": ("vaults_withdrawable",),
    "getvaultstate": ("vaults_withdrawable",),
    "unvault": ("vaults_withdrawable",),
    "withdrawfromvault": ("vaults_withdrawable",),
    "createpool": ("pool_balances",),
    "getpoolstate": ("pool_balances",),
    "joinpool": ("pool_balances",),
    "distributepool": ("pool_distribution",),
    "createbatch": ("batches_to_broadcast",),
    "addtobatch": ("batches_to_broadcast",),
    "getcongestion": ("congestion_metrics",),
    "getcongestionmetrics": ("congestion_metrics",),
    "broadcastbatch": ("batches_to_broadcast",),
    "decoderawtransaction": ("functions.wire.decode_transactions",),
    "createrawtransaction": ("functions.wire.encode_transaction",),
}

#: Side effects on a process, a socket or a module.
OUTSIDE = ("ping", "addnode", "disconnectnode", "setnetworkactive", "generatetoaddress", "prioritisetransaction", "stop", "uptime", "getmemoryinfo", "getrpcinfo", "help", "logging", "loadmodule", "unloadmodule", "reloadmodule", "listmodules", "getmoduleclispecs", "runmodulecli", "createcovenantproof", "getdescriptorinfo", "analyzepsbt")

#: Web routes and the methods they stand for.
ROUTES = {
    "chain/tip": "getbestblockhash", "chain/height": "getblockcount", "chain/info": "getblockchaininfo", "chain/difficulty": "getdifficulty", "chain/utxo": "gettxoutsetinfo", "chain/tips": "getchaintips", "chain/txstats": "getchaintxstats",
    "chain/prune": "getpruneinfo", "chain/index": "getindexinfo", "chain/verify": "verifychain", "blocks/{hash}": "getblock", "blocks/height/{h}": "getblock", "blocks/{hash}/transactions": "getblock", "blocks/{hash}/header": "getblockheader",
    "blocks/{hash}/stats": "getblockstats", "blocks/{hash}/filter": "getblockfilter", "blocks/{hash}/invalidate": "invalidateblock", "blocks/{hash}/reconsider": "reconsiderblock", "transactions/{txid}": "gettransactiondetails",
    "transactions/{txid}/confirmations": "getrawtransaction", "transactions/{txid}/outputs/{n}": "gettxout", "transactions/test": "testmempoolaccept", "addresses/{a}/balance": "getaddressinfo", "addresses/{a}/transactions": "getaddressinfo",
    "addresses/{a}/utxos": "getaddressinfo", "mempool": "getrawmempool", "mempool/transactions/{txid}": "getmempoolentry", "mempool/transactions/{txid}/ancestors": "getmempoolancestors", "mempool/transactions/{txid}/descendants": "getmempooldescendants",
    "mempool/stats": "getmempoolinfo", "mempool/save": "savemempool", "network/info": "getnetworkinfo", "network/peers": "getpeerinfo", "network/connections/count": "getconnectioncount", "network/totals": "getnettotals", "network/nodes": "getaddednodeinfo",
    "network/addresses": "getnodeaddresses", "network/bans": "listbanned", "fees/estimate": "estimatesmartfee", "mining/info": "getmininginfo", "mining/block-template": "getblocktemplate",
}


def answer(ledger: Ledger, method: str):
    """DataFrames that answer a method, by query name. Raises KeyError for methods outside the catalogue."""
    found = registry.queries()
    return {name: found[name](ledger.spark, ledger.sf_dir) for name in METHODS[method] if name in found}
