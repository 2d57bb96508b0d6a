"""The test tables as row-addressed ones, and the SQL that numbers their rows alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from laminar.table import ColTable, cached

LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
KEYS = {"lineitem": LINE_KEYS, "orders": ["o_orderkey"], "events": ["event_id"], "customer": ["c_custkey"], "part": ["p_partkey"]}
STRIPES = {"lineitem": 10_000, "orders": 4_000, "events": 3_000, "customer": 500, "part": 500}
CHUNK = 1024


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> ColTable:
    return cached(spark, f"{sf_dir}/{name}.parquet", KEYS[name], STRIPES[name], CHUNK)


def numbered(name: str) -> str:
    """SQL of the table with row_id, stripe_id and chunk_id, for use in FROM."""
    order = ", ".join(KEYS[name])
    return (
        f"(SELECT *, row_id // {STRIPES[name]} AS stripe_id, row_id // {CHUNK} AS chunk_id FROM "
        f"(SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS row_id FROM {name}))"
    )
