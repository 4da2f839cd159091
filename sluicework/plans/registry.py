"""QUERIES and SQL: where queries are registered with what DuckDB must give."""

from __future__ import annotations

from ..session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a function (tables) -> DataFrame under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        SQL[f.__name__] = sql
        return f

    return register
