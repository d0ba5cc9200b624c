"""Where queries and their DuckDB twins are registered."""

from __future__ import annotations

from collections.abc import Callable

from brackwater.sources.model import MODEL_SQL

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None, own: bool = False):
    """Registers a function as the query of its name; ``sql`` follows the model's expressions."""

    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered already")
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql if own else f"{MODEL_SQL} {sql}"
        return f

    return add
