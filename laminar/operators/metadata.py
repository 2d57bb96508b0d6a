"""What the inspection language shows of a table: schema, stripes, streams, statistics, encodings and layout.

Streams are numbered in pre-order over the schema: 0 is the row's own nulls, then each column's leaves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laminar.operators import advisor, stats
from laminar.operators.scan import raw_size, with_starts
from laminar.table import ColTable

STRIPES_PER_GROUP = 4


def schema_tree(schema: T.StructType) -> list[tuple[int, int, str, str, str]]:
    """(stream, depth, path, name, kind) of each node, in pre-order."""
    out: list[tuple[int, int, str, str, str]] = []

    def walk(kind: T.DataType, name: str, path: str, depth: int) -> None:
        out.append((len(out), depth, path, name, kind.typeName() if not isinstance(kind, T.StructType) else "row"))
        inner = {
            "struct": lambda: [(f.name, f.dataType) for f in kind.fields],
            "array": lambda: [("element", kind.elementType)],
            "map": lambda: [("key", kind.keyType), ("value", kind.valueType)],
        }.get(kind.typeName(), lambda: [])()
        for n, k in inner:
            walk(k, n, f"{path}/{n}" if path else n, depth + 1)

    walk(schema, "root", "", 0)
    return out


def _schema(t: ColTable) -> T.StructType:
    return t.df.select(*t.columns).schema


def schema(t: ColTable) -> DataFrame:
    return t.held.sparkSession.createDataFrame(schema_tree(_schema(t)), "stream int, depth int, path string, name string, kind string")


def describe(t: ColTable) -> DataFrame:
    top = [(n, k, i) for i, depth, _, n, k in schema_tree(_schema(t)) if depth == 1]
    return t.held.sparkSession.createDataFrame(top, "column string, type string, stream int")


def _sized(t: ColTable):
    total = sum((raw_size(f) for f in _schema(t).fields), F.lit(0).cast("long"))
    return t.df.withColumn("_raw", total)


def stripes(t: ColTable) -> DataFrame:
    """(stripe_id, stripe_offset, size, rows); sizes are raw bytes."""
    sizes = _sized(t).groupBy("stripe_id").agg(F.sum("_raw").alias("size"), F.count("*").alias("rows"))
    return with_starts(sizes, "stripe_id", "size", "stripe_offset")


#: Pairs of a written table's metadata that are not its user's.
OWN = ("keys", "stripe_rows", "chunk_rows", "checksum")


def files(t: ColTable) -> DataFrame:
    """(section, size) of the files of a written table that was opened, by its folders."""
    spark = t.held.sparkSession
    if t.path is None:
        return spark.createDataFrame([], "section string, size long")
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(t.path)
    return held.groupBy(F.regexp_extract("path", "/([^/]+)/[^/]+$", 1).alias("section")).agg(F.sum("length").alias("size"))


def info(t: ColTable) -> DataFrame:
    """(version, stripes, rows, raw_size, columns, checksum, rate, metadata); the last three of a table that was opened.

    rate: raw bytes against those of the data's files; metadata: the user's pairs.
    """
    total = _sized(t).agg(F.sum("_raw").alias("raw_size"), F.count("*").alias("rows"))
    stored = files(t).where("section = 'data'").agg(F.sum("size").alias("stored"))
    names, own = ", ".join(t.columns), {k: v for k, v in sorted(t.about.items()) if k not in OWN}
    pairs = ", ".join(f"{k}={v}" for k, v in own.items())
    return total.crossJoin(F.broadcast(stored)).select(  # two single rows
        F.lit(1).alias("version"), F.lit(t.n_stripes).cast("long").alias("stripes"), "rows", "raw_size", F.lit(names).alias("columns"),
        F.lit(t.about.get("checksum")).cast("string").alias("checksum"), (F.col("raw_size") / F.col("stored")).alias("rate"), F.lit(pairs).alias("metadata"),
    )


def streams(t: ColTable, x=None) -> DataFrame:
    """(stripe_id, stream, name, items, nulls, length, stream_offset) of each top-level column; offsets are in the stripe."""
    at = {n: i for i, depth, _, n, _ in schema_tree(_schema(t)) if depth == 1}
    rows = t.df if x is None or x.stripe is None else t.stripe(x.stripe)
    facts = [F.struct(F.lit(at[f.name]).alias("stream"), F.lit(f.name).alias("name"), F.col(f.name).isNull().alias("null"), raw_size(f).alias("size")) for f in _schema(t).fields]
    long = rows.select("stripe_id", F.explode(F.array(*facts)).alias("s")).select("stripe_id", "s.*")
    found = long.groupBy("stripe_id", "stream", "name").agg(F.count_if(~F.col("null")).alias("items"), F.count_if("null").alias("nulls"), F.sum("size").alias("length"))
    before = Window.partitionBy("stripe_id").orderBy("stream").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("stream_offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def content(t: ColTable, x) -> DataFrame:
    names = {i: n for i, depth, _, n, _ in schema_tree(_schema(t)) if depth == 1}
    if x.stream not in names:
        raise ValueError(f"no stream {x.stream}")
    rows = t.df if x.stripe is None else t.stripe(x.stripe)
    return rows.select("row_id", F.col(names[x.stream]).alias("value")).where(F.col("value").isNotNull()).orderBy("row_id")


def stats_of(t: ColTable) -> DataFrame:
    """Each column's statistics, its type, and its physical size: what its chosen encodings take by estimate, where its
    type has one."""
    schema = _schema(t)
    types = F.create_map(*[F.lit(x) for f in schema.fields for x in (f.name, f.dataType.typeName())])
    known = [f.name for f in schema.fields if isinstance(f.dataType, T.AtomicType) and advisor.estimable(f.dataType)]
    sized = advisor.choose_all(t.df, known).groupBy("column").agg(F.sum("size").alias("physical_size"))
    return stats.column_stats(t.df.select(*t.columns)).withColumn("type", types[F.col("column")]).join(sized, "column", "left")


#: The streams of an encoding within it, and how each is encoded.
NESTED = {
    "Dictionary": (("indices", "FixedBitWidth"), ("alphabet", "Trivial")), "RLE": (("lengths", "FixedBitWidth"), ("values", "FixedBitWidth")),
    "MainlyConstant": (("common", "SparseBool"), ("others", "FixedBitWidth")), "SparseBool": (("rows", "FixedBitWidth"),),
}


def encoding(t: ColTable, x=None) -> DataFrame:
    """(column, stripe_id, depth, path, encoding, size): each column's chosen encoding, and below it the streams in it.

    Sizes are those of whole columns; the streams in them have none of their own.
    """
    rows = t.df if x is None or x.stripe is None else t.stripe(x.stripe)
    found = advisor.choose_all(rows, t.columns)
    node = lambda path, encoding, depth, size: F.struct(F.lit(depth).alias("depth"), path.alias("path"), encoding.alias("encoding"), size.cast("long").alias("size"))
    tree = F.array(node(F.col("column"), F.col("encoding"), 0, F.col("size")))

    def below(parent: str, path, depth: int) -> list:
        out = []
        for name, kind in NESTED.get(parent, ()):
            own = F.concat(path, F.lit(f"/{name}"))
            out += [node(own, F.lit(kind), depth, F.lit(None)), *below(kind, own, depth + 1)]
        return out

    for kind in NESTED:
        tree = F.when(F.col("encoding") == kind, F.concat(F.array(node(F.col("column"), F.col("encoding"), 0, F.col("size"))), F.array(*below(kind, F.col("column"), 1)))).otherwise(tree)
    return found.select("column", "stripe_id", F.explode(tree).alias("n")).select("column", "stripe_id", "n.*")


def histogram(t: ColTable, x=None) -> DataFrame:
    """(encoding, instances, bytes, share): chosen encodings by stripe and column, largest first."""
    rows = t.df if x is None or x.stripe is None else t.stripe(x.stripe)
    chosen = advisor.choose_all(rows, t.columns, by=["stripe_id"])
    groups = chosen.groupBy("encoding").agg(F.count("*").alias("instances"), F.sum("size").alias("bytes"))
    total = groups.agg(F.sum("bytes").alias("t"))
    out = groups.crossJoin(F.broadcast(total)).select("encoding", "instances", "bytes", (F.col("bytes") / F.col("t")).alias("share")).orderBy(F.desc("bytes"), "encoding")  # one row
    return out.limit(x.top) if x is not None and x.top else out


def index(t: ColTable) -> DataFrame:
    """(part, first_row, rows, and the first and last key as text) of each chunk."""
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in t.keys])
    chunks = t.df.select(F.col("chunk_id").alias("part"), "row_id", key.alias("k")).groupBy("part")
    return chunks.agg(F.min("row_id").alias("first_row"), F.count("*").alias("rows"), F.min_by("k", "row_id").alias("first_key"), F.max_by("k", "row_id").alias("last_key"))


def layout(t: ColTable) -> DataFrame:
    """(section, offset, size): the stripes, by raw bytes, and of a written table that was opened its files beside them."""
    body = stripes(t).select(F.concat(F.lit("stripe "), F.col("stripe_id")).alias("section"), F.col("stripe_offset").alias("offset"), "size")
    if t.path is None:
        return body
    return body.unionByName(files(t).select("section", F.lit(None).cast("long").alias("offset"), "size"))


def stripes_metadata(t: ColTable) -> DataFrame:
    return stripes(t).select("stripe_id", F.floor(F.col("stripe_id") / STRIPES_PER_GROUP).cast("long").alias("group_id"), "rows")


def stripe_groups(t: ColTable) -> DataFrame:
    group = F.floor(F.col("stripe_id") / STRIPES_PER_GROUP).cast("long").alias("group_id")
    return stripes(t).groupBy(group).agg(F.count("*").alias("stripes"), F.sum("rows").alias("rows"), F.sum("size").alias("size"))


def sections(t: ColTable) -> DataFrame:
    rows = [("schema", len(schema_tree(_schema(t)))), ("stats", len(t.columns)), ("stripes", t.n_stripes), ("index", len(t.parts))]
    return t.held.sparkSession.createDataFrame(rows, "section string, entries long")
