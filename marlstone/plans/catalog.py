"""The registry of named queries and of the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.storage import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its oracle where SQL can express it."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@query(
    "agg_revenue_by_flag",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS n_rows, min(l_shipdate) AS first_ship, max(l_quantity) AS max_qty
    FROM lineitem GROUP BY ALL
    """,
)
def _revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.count("*").alias("n_rows"), F.min("l_shipdate").alias("first_ship"), F.max("l_quantity").alias("max_qty"))
    )


def load() -> None:
    """Import every module that registers queries."""
    import importlib
    import pkgutil

    import marlstone.plans as here

    for found in pkgutil.iter_modules(here.__path__):
        importlib.import_module(f"marlstone.plans.{found.name}")
