"""Registry of queries: a DataFrame builder and, where SQL can say it, the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: str | None = None):
    """Registers a builder under `name`. `needs` is the last common table the SQL builds on."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(needs, sql) if needs else sql
        return fn
    return add


def with_tables(needs: str, sql: str) -> str:
    from axlewatch.plans.common_sql import TABLES, closure
    parts = ",\n".join(f"{n} AS ({TABLES[n][1]})" for n in closure(needs.split()))
    body = sql.strip()
    return f"WITH {parts}" + (f",\n{body[5:]}" if body[:5].upper() == "WITH " else f"\n{body}")
