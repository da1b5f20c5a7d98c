"""Where queries register: name -> (query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}


def register(sql: str | None = None):
    def add(f: Query) -> Query:
        CATALOG[f.__name__] = (f, sql)
        return f

    return add
