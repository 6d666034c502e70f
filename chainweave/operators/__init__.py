"""Batch operators over the ledger; importing registers their queries."""

from chainweave.operators import access, aggregates, graph, network, ordered, payments, pool, records, relay, sets, temporal  # noqa: F401
