"""Named queries and the DuckDB statements they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gravitas.sources.accidents import duckdb_accidents_sql, duckdb_predictions_ctes

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is defined twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def with_ctes(body: str, ctes: list[tuple[str, str]]) -> str:
    return "with " + ",\n".join(f"{n} as ({q})" for n, q in ctes) + "\n" + body


def on_accidents(body: str, *ctes: tuple[str, str]) -> str:
    return with_ctes(body, [("accidents", duckdb_accidents_sql()), *ctes])


def on_predictions(body: str, *ctes: tuple[str, str]) -> str:
    return with_ctes(body, [*duckdb_predictions_ctes(), *ctes])


def r(expr: str, digits: int = 6) -> str:
    """Rounded double in DuckDB, without negative zero."""
    return f"(round(cast({expr} as double), {digits}) + 0.0)"
