"""All queries of the library by name, and the oracle SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None) -> Callable:
    """Registers a query under its function's name, with its oracle SQL if there is one."""

    def register(function: Callable) -> Callable:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return register
