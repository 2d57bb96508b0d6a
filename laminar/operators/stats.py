"""Statistics of columns: mergeable ones by stripe and file, and those that encodings are chosen by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laminar.operators.scan import raw_size

STATS = "column string, values long, nulls long, min_long long, max_long long, min_double double, max_double double, min_string string, max_string string, size long"
_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _facts(f: T.StructField) -> Column:
    """The aggregates of one column, as a struct. NaN takes no part in a minimum or maximum, wherever it stands: a running
    comparison that begins with it would keep it, and give another answer for another order of the rows."""
    c, kind = F.col(f"`{f.name}`"), f.dataType
    parts = [F.lit(f.name).alias("column"), F.count(c).alias("values"), F.count_if(c.isNull()).alias("nulls")]
    number = c.cast("double")
    sound = F.when(~F.isnan(number), number) if isinstance(kind, _FLOATS) else None
    for n, agg in (("min", F.min), ("max", F.max)):
        parts.append((agg(c.cast("long")) if isinstance(kind, _INTS) else _null("long")).alias(f"{n}_long"))
    for n, agg in (("min", F.min), ("max", F.max)):
        parts.append((agg(sound) if sound is not None else _null("double")).alias(f"{n}_double"))
    for n, agg in (("min", F.min), ("max", F.max)):
        parts.append((agg(c) if isinstance(kind, T.StringType) else _null("string")).alias(f"{n}_string"))
    parts.append(F.coalesce(F.sum(raw_size(f)), F.lit(0)).cast("long").alias("size"))
    return F.struct(*parts)


def column_stats(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """A row for each column (and group): one pass over the table, with partial aggregates before the shuffle."""
    names = [c for c in (columns or df.columns) if c not in by]
    wide = df.groupBy(*by).agg(*[_facts(df.schema[c]).alias(f"_s{i}") for i, c in enumerate(names)])
    return wide.select(*by, F.explode(F.array(*[f"_s{i}" for i in range(len(names))])).alias("s")).select(*by, "s.*")


def merge_stats(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Statistics of parts merged to those of the whole."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("values", "nulls")]
    ends = [f(f"{n}_{k}").alias(f"{n}_{k}") for k in ("long", "double", "string") for n, f in (("min", F.min), ("max", F.max))]
    return parts.groupBy(*by, "column").agg(*sums, *ends, F.sum("size").cast("long").alias("size"))


def as_vectors(stats: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row with an array for each statistic, in the columns' order; bounded by the number of columns."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("column"))
    names = ["column", "values", "nulls", "min_long", "max_long", "min_double", "max_double", "min_string", "max_string", "size"]
    rows = stats.agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), *names))).alias("rows"))
    return rows.select(*[F.col("rows")[n].alias(n) for n in names])


def from_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.explode(F.arrays_zip(*vectors.columns)).alias("s")).select("s.*")


# Statistics for the choice of encodings, over values in row order.


def runs(rows: DataFrame, value: str = "v", by: str = "stripe_id") -> DataFrame:
    """(by, run, v, length, first_row): runs of equal values in row order within each group."""
    order = Window.partitionBy(by).orderBy("row_id")
    starts = rows.withColumn("_new", (~F.col(value).eqNullSafe(F.lag(value).over(order)) | F.lag("row_id").over(order).isNull()).cast("int"))
    numbered = starts.withColumn("run", F.sum("_new").over(order) - 1)
    return numbered.groupBy(by, "run").agg(F.first(value).alias("v"), F.count("*").alias("length"), F.min("row_id").alias("first_row"))


def run_stats(rows: DataFrame, value: str = "v", by: str = "stripe_id") -> DataFrame:
    return runs(rows, value, by).groupBy(by).agg(F.count("*").alias("runs"), F.min("length").alias("min_run"), F.max("length").alias("max_run"))


def unique_counts(rows: DataFrame, value: str = "v", by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by, value).agg(F.count("*").alias("n"))


def most_frequent(rows: DataFrame, value: str = "v", by: Sequence[str] = ()) -> DataFrame:
    """The most frequent value and its count; ties go to the smaller value."""
    counts = unique_counts(rows, value, by)
    best = F.max(F.struct("n")).alias("_b")
    if not by:
        top = counts.agg(best)
        return counts.join(F.broadcast(top), F.col("n") == F.col("_b.n")).agg(F.min(value).alias(value), F.max("n").alias("n"))  # one row
    top = counts.groupBy(*by).agg(F.max("n").alias("_n"))
    return counts.join(top, list(by)).where("n = _n").groupBy(*by).agg(F.min(value).alias(value), F.max("n").alias("n"))


def varint_buckets(rows: DataFrame, value: str = "v") -> DataFrame:
    """(bucket, n): values less the minimum, by how many groups of seven bits they need."""
    least = rows.agg(F.min(value).alias("_m"))
    bits = F.length(F.bin((F.col(value) - F.col("_m")).cast("long")))
    bucket = F.greatest(F.lit(0), F.ceil(bits / 7) - 1).cast("int").alias("bucket")
    return rows.crossJoin(F.broadcast(least)).groupBy(bucket).agg(F.count("*").alias("n"))  # one row


def block_range(rows: DataFrame, value: str = "v", block: int = 1024) -> DataFrame:
    """(block, count, min, max) of each ``block`` rows."""
    return rows.groupBy(F.floor(F.col("row_id") / block).cast("long").alias("block")).agg(F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"))


def lengths(rows: DataFrame, value: str = "v") -> DataFrame:
    """Shortest and longest string, and all strings' bytes."""
    n = F.octet_length(value)
    return rows.agg(F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.sum(n).alias("total_len"))


def chunk_stats(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy("chunk_id").agg(F.count("*").alias("rows"), F.count_if(F.col(value).isNull()).alias("nulls"))
