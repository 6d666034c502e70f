"""Chainweave: ledger analytics on Spark DataFrames."""
