"""Registered queries, each with the same result in plain SQL over the shared tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Named SQL building blocks; a query's SQL pulls in the ones it mentions.
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def with_ctes(sql: str) -> str:
    """Prefix a statement with the building blocks it uses, in order of definition."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(CTES[name])
    if not needed:
        return sql.strip()
    parts = ",\n".join(f"{name} as (\n{body}\n)" for name, body in CTES.items() if name in needed)
    return f"with {parts}\n{sql.strip()}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL where SQL can express it."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return add
