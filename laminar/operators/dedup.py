"""Values equal to the one before, kept once: arrays, maps and streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(column: str, is_map: bool) -> Column:
    return F.array_sort(F.map_entries(column)) if is_map else F.col(column)


def consecutive(df: DataFrame, column: str, by: str, order: str, is_map: bool = False) -> DataFrame:
    """df with ``is_new`` and ``slot``: whether a row's value differs from the one before in its group, and the number
    of the stored value that it shares. Null differs from all."""
    own = Window.partitionBy(by).orderBy(order)
    key = df.withColumn("_c", canonical(column, is_map))
    same = (F.col("_c") == F.lag("_c").over(own)) & F.col("_c").isNotNull()
    marked = key.withColumn("is_new", ~F.coalesce(same, F.lit(False)))
    return marked.withColumn("slot", F.sum(F.col("is_new").cast("int")).over(own) - 1).drop("_c")


def stored(marked: DataFrame, column: str, by: str) -> DataFrame:
    """(group, slot, value) of what is stored."""
    return marked.where("is_new").select(by, "slot", column)


def restore(marked: DataFrame, kept: DataFrame, column: str, by: str) -> DataFrame:
    return marked.drop(column).join(kept, [by, "slot"])


def dedup_stats(marked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return marked.groupBy(*by).agg(F.count("*").alias("values"), F.count_if("is_new").alias("stored"))


def stream_digests(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """(group, digest, columns): columns of a group with the same values in the same order share their bytes.

    Digests are sums of hashes of (place, value), so they need no order in a task: partial sums meet.
    """
    facts = [F.struct(F.lit(c).alias("column"), F.xxhash64("row_id", F.col(c).cast("string")).alias("h")) for c in columns]
    long = df.select(by, F.explode(F.array(*facts)).alias("f")).select(by, "f.column", "f.h")
    digests = long.groupBy(by, "column").agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("digest"), F.bit_xor("h").alias("x"))
    return digests.groupBy(by, "digest", "x").agg(F.array_sort(F.collect_list("column")).alias("columns"))
