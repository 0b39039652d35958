"""Registry of queries: a Spark callable and, where SQL can say the same, an oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None
    operators: str


QUERIES: dict[str, Entry] = {}


def query(operators: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name. ``operators`` lists the inventory ids it covers."""
    def add(fn: Query) -> Query:
        if fn.__name__ in QUERIES:
            raise ValueError(f"{fn.__name__} is registered twice")
        QUERIES[fn.__name__] = Entry(fn, sql, operators)
        return fn

    return add
