"""Scan operators over DataFrames and row-addressed tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laminar.table import ColTable


def selective(df: DataFrame, columns: Sequence[str], filters: Sequence[Column]) -> DataFrame:
    """Projection and filters in one scan; both reach the reader."""
    return df.where(reduce(lambda a, b: a & b, filters, F.lit(True))).select(*columns)


def stripe_sizes(t: ColTable, texts: Sequence[str], fixed: int) -> DataFrame:
    """Each stripe's raw bytes, and the offset at which it starts: one row a stripe."""
    size = reduce(lambda a, b: a + b, [F.octet_length(c) for c in texts], F.lit(fixed))
    sizes = t.df.groupBy("stripe_id").agg(F.sum(size).cast("long").alias("size"))
    return with_starts(sizes, "stripe_id", "size", "stripe_offset")


#: Numbered parts whose sizes one window sums.
RUN = 4096


def with_starts(parts: DataFrame, order: str, size: str, out: str) -> DataFrame:
    """The sum of the sizes before each part, which ``order`` numbers.

    Sums run over RUN numbers at a time, and one window over a row for each such run gives what lies before it.
    """
    run = F.floor(F.col(order) / RUN).alias("_run")
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = parts.groupBy(run).agg(F.sum(size).alias("_s")).select("_run", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("_run", run).join(runs, "_run")
    return placed.withColumn(out, (F.col("_before") + F.coalesce(F.sum(size).over(inside), F.lit(0))).cast("long")).drop("_run", "_before")


def with_latest(parts: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """The greatest value of the parts before each one, by runs of numbers as in ``with_starts``; null before the first."""
    run = F.floor(F.col(order) / RUN).alias("_run")
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = parts.groupBy(run).agg(F.max(value).alias("_m")).select("_run", F.max("_m").over(before).alias("_before"))
    inside = Window.partitionBy("_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("_run", run).join(runs, "_run")
    return placed.withColumn(out, F.greatest("_before", F.max(value).over(inside))).drop("_run", "_before")


def selected(t: ColTable, marks: DataFrame) -> DataFrame:
    """The rows that sparse marks (row_id) name: only the range between the first and the last mark is read."""
    ends = marks.agg(F.min("row_id").alias("a"), F.max("row_id").alias("z")).first()
    near = t.rows(0, 0) if ends["a"] is None else t.rows(ends["a"], ends["z"] + 1)
    return near.join(marks.select("row_id"), "row_id", "left_semi")


def split(t: ColTable, texts: Sequence[str], fixed: int, start: int, end: int) -> DataFrame:
    """Rows of the stripes that start at a byte offset in [start, end); each row is in one split of a partition."""
    sizes = stripe_sizes(t, texts, fixed).where(F.col("stripe_offset").between(start, end - 1))
    return t.df.join(sizes.select("stripe_id", "stripe_offset"), "stripe_id")


def every(t: ColTable, n: int, at: int) -> DataFrame:
    """One row of each n, by row number: a sample that repeats."""
    return t.df.where(F.col("row_id") % n == at)


def evolve(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """df read as another schema: missing columns are null, types are widened, and others are left out."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    have = {f.name: f.dataType for f in df.schema.fields}
    for f in wanted.fields:
        if f.name in have and have[f.name] != f.dataType and (have[f.name].typeName(), f.dataType.typeName()) not in WIDENS:
            raise TypeError(f"{f.name}: {have[f.name].simpleString()} does not widen to {f.dataType.simpleString()}")
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields])


_INTS = ["byte", "short", "integer", "long"]
WIDENS = {(a, b) for i, a in enumerate(_INTS) for b in _INTS[i + 1 :]} | {("float", "double"), ("boolean", "byte")} | {("boolean", x) for x in _INTS}


def stream(df: DataFrame, leaf: Column) -> DataFrame:
    """The values of one leaf that are not null, with their row numbers."""
    return df.select("row_id", leaf.alias("value")).where(F.col("value").isNotNull())


def raw_size(field: T.StructField) -> Column:
    """A value's logical bytes: fixed widths, 12 for a timestamp, a string's bytes, and 1 for null."""
    widths = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "long": 8, "float": 4, "double": 8, "timestamp": 12, "timestamp_ntz": 12}
    kind, c = field.dataType, F.col(field.name)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(c)
    elif isinstance(kind, T.ArrayType):
        inner = T.StructField("x", kind.elementType)
        size = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + element_size(inner, x))
    elif isinstance(kind, T.MapType):
        keys, values = T.StructField("k", kind.keyType), T.StructField("v", kind.valueType)
        size = F.aggregate(F.map_entries(c), F.lit(0).cast("long"), lambda a, e: a + element_size(keys, e["key"]) + element_size(values, e["value"]))
    elif isinstance(kind, T.StructType):
        size = reduce(lambda a, b: a + b, [element_size(f, c[f.name]) for f in kind.fields], F.lit(0))
    else:
        size = F.lit(widths[kind.typeName()])
    return F.when(c.isNull(), 1).otherwise(size).cast("long")


def element_size(field: T.StructField, value: Column) -> Column:
    widths = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "long": 8, "float": 4, "double": 8, "timestamp": 12, "timestamp_ntz": 12}
    size = F.octet_length(value) if isinstance(field.dataType, (T.StringType, T.BinaryType)) else F.lit(widths[field.dataType.typeName()])
    return F.when(value.isNull(), 1).otherwise(size).cast("long")


def row_size(df: DataFrame) -> DataFrame:
    """The mean logical bytes of a row, 1 at least."""
    total = reduce(lambda a, b: a + b, [raw_size(f) for f in df.schema.fields])
    return df.agg(F.greatest(F.lit(1), F.floor(F.sum(total) / F.count("*"))).cast("long").alias("row_size"))


def key_order(t: ColTable, key: str) -> DataFrame:
    """How often a key is smaller than the one before, or equal to it, in row order.

    Neighbours within a chunk are compared by a window over the chunk, and chunks by their first and last keys.
    """
    inside = Window.partitionBy("chunk_id").orderBy("row_id")
    steps = t.df.select("chunk_id", F.col(key).alias("k"), F.lag(key).over(inside).alias("p"))
    edges = t.df.groupBy("chunk_id").agg(F.min_by(key, "row_id").alias("k"), F.max_by(key, "row_id").alias("last"))
    before = edges.select((F.col("chunk_id") + 1).alias("chunk_id"), F.col("last").alias("p"))
    joins = edges.select("chunk_id", "k").join(before, "chunk_id")
    both = steps.unionByName(joins)
    return both.agg(F.count_if(F.col("k") < F.col("p")).alias("out_of_order"), F.count_if(F.col("k") == F.col("p")).alias("repeated"))


def secondary(t: ColTable, key: str) -> DataFrame:
    """(key, row_id, entry): the entries of a secondary index in (key, row) order, numbered."""
    laid = ColTable.lay_out(t.df.select(F.col(key), F.col("row_id").alias("_row")), [key, "_row"])
    return laid.df.select(key, F.col("_row").alias("row_id"), F.col("row_id").alias("entry"))


def buckets(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows and key range of each bucket of a point index."""
    return df.groupBy((F.col(key) % n).alias("bucket")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))


def composite_order(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """df with each row's place in the order of several keys, each ascending (True) or descending.

    Numbers come from a range partitioning, as a laid-out table's do, so no task sorts all rows.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(k).asc() if up else F.col(k).desc() for k, up in keys]
    from laminar.sources.shared import materialize

    held = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    counts = held.groupBy(F.shiftright("_at", 33).alias("_p")).count()
    starts = with_starts(counts, "_p", "count", "_first").select("_p", "_first")
    numbered = held.withColumn("_p", F.shiftright("_at", 33)).join(F.broadcast(starts), "_p")  # a row a partition
    place = F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn("place", place.cast("long")).drop("_at", "_p", "_first")
