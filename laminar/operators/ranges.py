"""Sets of half-open row ranges (start_row, end_row), by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intersect(ranges: DataFrame, start: int, end: int) -> DataFrame:
    """Ranges cut to [start, end); what is empty then is left out."""
    cut = ranges.withColumn("start_row", F.greatest("start_row", F.lit(start))).withColumn("end_row", F.least("end_row", F.lit(end)))
    return cut.where(F.col("start_row") < F.col("end_row"))


def union(ranges: DataFrame, by: str) -> DataFrame:
    """Ranges that overlap or touch, merged, within each group."""
    order = Window.partitionBy(by).orderBy("start_row", "end_row")
    reach = F.max("end_row").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.where("start_row < end_row").withColumn("_new", F.coalesce(F.col("start_row") > reach, F.lit(True)).cast("int"))
    grouped = marked.withColumn("_g", F.sum("_new").over(order))
    return grouped.groupBy(by, "_g").agg(F.min("start_row").alias("start_row"), F.max("end_row").alias("end_row")).drop("_g")


def split(ranges: DataFrame, by: str) -> DataFrame:
    """The pieces between all starts and ends of a group that some range covers, and how many cover each.

    Covering is a running sum of starts less ends, so no range is compared with another.
    """
    marks = ranges.where("start_row < end_row").select(by, F.explode(F.array(F.struct(F.col("start_row").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_row").alias("at"), F.lit(-1).alias("d")))).alias("m"))
    points = marks.groupBy(by, F.col("m.at").alias("start_row")).agg(F.sum("m.d").alias("d"))
    order = Window.partitionBy(by).orderBy("start_row")
    pieces = points.withColumn("end_row", F.lead("start_row").over(order)).withColumn("covering", F.sum("d").over(order))
    return pieces.where("covering > 0").select(by, "start_row", "end_row", "covering")


def islands(rows: DataFrame, by: str) -> DataFrame:
    """Row numbers as ranges of consecutive ones, within each group."""
    order = Window.partitionBy(by).orderBy("row_id")
    marked = rows.withColumn("_g", F.col("row_id") - F.row_number().over(order))
    return marked.groupBy(by, "_g").agg(F.min("row_id").alias("start_row"), (F.max("row_id") + 1).alias("end_row")).drop("_g")
