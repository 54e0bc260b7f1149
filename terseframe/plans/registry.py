"""Registered queries and the SQL that checks them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def as_bigint(columns: dict[str, list[str]]) -> None:
    for key, names in columns.items():
        cast = ", ".join(f'"{n}"::BIGINT AS "{n}"' for n in names)
        ORACLES[key] = f"SELECT * REPLACE ({cast}) FROM ({ORACLES[key]})"
