"""Methods that modules add to the catalogue: registration, overrides, removal by module, and hooks of which the first answer counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweave.plans.catalogue import METHODS, OUTSIDE, answer
from chainweave.views import Ledger

Handler = Callable[[Ledger, dict], DataFrame]


class Extensions:
    """Named handlers of modules. A core method is replaced only by override; a name belongs to one module."""

    def __init__(self) -> None:
        self._handlers: dict[str, tuple[str, Handler]] = {}

    def register(self, method: str, module: str, handler: Handler) -> None:
        if method in METHODS or method in OUTSIDE:
            raise ValueError(f"{method} is a core method")
        self._claim(method, module, handler)

    def override(self, method: str, module: str, handler: Handler) -> None:
        if method not in METHODS:
            raise ValueError(f"{method} is not a core method")
        self._claim(method, module, handler)

    def _claim(self, method: str, module: str, handler: Handler) -> None:
        owner = self._handlers.get(method)
        if owner and owner[0] != module:
            raise ValueError(f"{method} belongs to {owner[0]}")
        self._handlers[method] = (module, handler)

    def unregister_module(self, module: str) -> int:
        gone = [m for m, (owner, _) in self._handlers.items() if owner == module]
        for m in gone:
            del self._handlers[m]
        return len(gone)

    def call(self, ledger: Ledger, method: str, params: dict | None = None) -> DataFrame | dict[str, DataFrame]:
        if method in self._handlers:
            return self._handlers[method][1](ledger, params or {})
        return answer(ledger, method)


def first_answer(*hooks: Column) -> Column:
    """The first hook that answers, by order."""
    return F.coalesce(*hooks)
