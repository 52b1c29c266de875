"""Registered queries and the SQL that cross-checks them."""

from __future__ import annotations

from collections.abc import Callable

from loomcast.plans.base import Query
from loomcast.plans.sqltext import sql

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def oracle(body: str, doubles: str = "", digits: int = 6) -> str:
    """Full SQL text; the named double columns are rounded like on the Spark side."""
    if doubles:
        swaps = ", ".join(f"round({c}, {digits}) + 0.0 as {c}" for c in doubles.split())
        body = f"select * replace ({swaps}) from (\n{body.strip()})"
    return sql(body)


def query(body: str | None = None, doubles: str = "", digits: int = 6) -> Callable[[Query], Query]:
    """Register a query under its function name, with its check if one is given."""

    def wrap(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if body is not None:
            ORACLE[fn.__name__] = oracle(body, doubles, digits)
        return fn

    return wrap
