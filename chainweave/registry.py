"""Named ledger queries, each with equivalent SQL for an independent engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chainweave.views import CTES, TABLES, Ledger, with_views

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Callable[[Ledger], DataFrame]], Callable[[Ledger], DataFrame]]:
    """Registers a function of a Ledger. oracle: SQL over the ledger's relations and the base tables."""

    def add(f: Callable[[Ledger], DataFrame]) -> Callable[[Ledger], DataFrame]:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = lambda spark, sf_dir: f(Ledger(spark, sf_dir))
        if oracle is not None:
            _oracles[name] = with_views(oracle)
        return f

    return add


def spark_sql(ledger: Ledger, sql: str, **more: DataFrame) -> DataFrame:
    """Runs Spark SQL that names relations, base tables and `more` in braces."""
    named = {n: ledger[n] for n in set(re.findall(r"\{(\w+)\}", sql)) if n in CTES or n in TABLES}
    return ledger.spark.sql(sql, **named, **more)


def register_sql(name: str, sql: str, oracle: str | None = None) -> None:
    """Registers Spark SQL. Without an oracle of its own, the other engine runs the same statement, in its own spelling of integer division and digests."""
    if oracle is None:
        oracle = re.sub(r"\{(\w+)\}", r"\1", sql)
        oracle = re.sub(r"\bdiv\b", "//", oracle)
        oracle = re.sub(r"\bsha2\(([^()]*(?:\([^()]*\)[^()]*)*), 256\)", r"sha256(\1)", oracle)
        oracle = re.sub(r"\bAS STRING\b", "AS VARCHAR", oracle, flags=re.I)
    register(name, oracle)(lambda ledger: spark_sql(ledger, sql))


def restate(name: str, oracle: str) -> None:
    """Gives a registered query SQL over the base tables alone, in place of its own statement in the other engine's spelling."""
    if name not in _queries:
        raise KeyError(name)
    _oracles[name] = oracle


def _load() -> None:
    import chainweave.operators
    import chainweave.streaming  # noqa: F401
    from chainweave.operators import restated  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return _queries


def oracle_sql() -> dict[str, str]:
    _load()
    return _oracles
