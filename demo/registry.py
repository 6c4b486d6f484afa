"""Registry of demo queries."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from demo.views import DUCK_VIEWS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def duck(body: str) -> str:
    """DuckDB statement over the demo views; `body` is a SELECT, or starts with further `, name AS (..)`."""
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in DUCK_VIEWS.items()) + "\n" + body


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = duck(oracle)
        return function

    return add
