"""Named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
#: Functions on rows of their own, which tests compare with their SQL; no queries.
CASES: dict[str, tuple[Callable, str]] = {}


def case(sql: str):
    def register(function: Callable) -> Callable:
        CASES[function.__name__] = function, sql
        return function

    return register


def query(sql: str | None = None):
    """Registers the function under its name, with the SQL for the same rows."""

    def register(function: Callable) -> Callable:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register
