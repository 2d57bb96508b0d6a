"""Registered queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from laminar.plans import dsl, lookup_queries, report_queries, scan_queries, stat_queries
from laminar.plans.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {**scan_queries.Q, **lookup_queries.Q, **stat_queries.Q, **report_queries.Q}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dsl.run(table(spark, sf_dir, "lineitem"), "SELECT l_orderkey, l_extendedprice LIMIT 5 OFFSET 100 STRIPE 0")


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
