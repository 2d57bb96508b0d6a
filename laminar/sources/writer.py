"""Writing tables: where stripes are cut, how their streams are laid out, and a writer with sidecar tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laminar.operators import stats
from laminar.operators.scan import raw_size, with_latest, with_starts
from laminar.table import ColTable

#: The default raw size at which a stripe ends.
STRIPE_BYTES = 256 << 20
COMPRESSION = ("zstd", "lz4", "snappy", "none")


@dataclass
class WriterOptions:
    """What a table is written with, as from a table's parameters."""

    stripe_rows: int = 10_000
    chunk_rows: int = 1024
    compression: str = "zstd"
    user_metadata: dict[str, str] = field(default_factory=dict)
    checksum: bool = True

    @classmethod
    def parse(cls, params: dict[str, str]) -> WriterOptions:
        out = cls()
        for k, v in params.items():
            if k in ("stripe_rows", "chunk_rows"):
                setattr(out, k, int(v))
            elif k == "compression":
                if v not in COMPRESSION:
                    raise ValueError(f"no codec {v!r}")
                out.compression = v
            elif k == "checksum":
                out.checksum = v.lower() == "true"
            else:
                out.user_metadata[k] = v
        return out


def cut_by_key(df: DataFrame, key: str, order: str, max_rows: int = 0, done: Column | None = None) -> DataFrame:
    """df with ``part``: of each key's rows, in order, the number of the run of ``max_rows`` that each falls in.

    This is for rows that are not in a table's order yet, as those of a stream: a key's rows are one sequence wherever they
    stand. done: how many rows of the key were cut before. ``cut_by_change`` cuts a table in row order.
    """
    own = Window.partitionBy(key).orderBy(order)
    place = F.row_number().over(own) - 1 + (done if done is not None else F.lit(0))
    return df.withColumn("part", (F.floor(place / max_rows) if max_rows else F.lit(0)).cast("long"))


def cut_by_change(t: ColTable, key: str, max_rows: int = 0) -> DataFrame:
    """(row_id, key, stripe): a new stripe at each change of key in row order, and after ``max_rows`` rows without one.

    Changes within a chunk come from a window over it; a chunk's first row is compared with the last of the one before,
    and what crosses chunks, the start of the run that goes on and the stripes before, comes from a row for each chunk.
    """
    inside = Window.partitionBy("chunk_id").orderBy("row_id")
    rows = t.df.select("chunk_id", "row_id", F.col(key).alias("key"))
    last = rows.groupBy("chunk_id").agg(F.max_by("key", "row_id").alias("_last")).select((F.col("chunk_id") + 1).alias("chunk_id"), "_last")
    first_row = F.row_number().over(inside) == 1
    before = F.when(first_row, F.col("_last")).otherwise(F.lag("key").over(inside))
    changed = rows.join(last, "chunk_id", "left").withColumn("_new", (F.col("row_id") == 0) | ~F.col("key").eqNullSafe(before))
    started = changed.withColumn("_run", F.max(F.when(F.col("_new"), F.col("row_id"))).over(inside))
    # The last start of a run in each chunk; chunks without one carry on that of an earlier chunk: the greatest so far.
    carried = with_latest(started.groupBy("chunk_id").agg(F.max("_run").alias("_own")), "chunk_id", "_own", "_carried")
    run = F.coalesce("_run", "_carried")
    placed = started.join(carried.select("chunk_id", "_carried"), "chunk_id").withColumn("_place", F.col("row_id") - run)
    cut = (F.col("_place") % max_rows == 0) if max_rows else (F.col("_place") == 0)
    marked = placed.withColumn("_cut", cut.cast("long"))
    sums = with_starts(marked.groupBy("chunk_id").agg(F.sum("_cut").alias("_n")), "chunk_id", "_n", "_stripes")
    stripe = F.col("_stripes") + F.sum("_cut").over(inside) - 1
    return marked.join(sums.select("chunk_id", "_stripes"), "chunk_id").select("row_id", "key", stripe.cast("long").alias("stripe"))


def cut_by_size(t: ColTable, limit: int, flush: Callable[[dict], bool] | None = None) -> DataFrame:
    """(chunk_id, stripe): stripes that end with the chunk in which their raw bytes reach ``limit``, or ``flush`` says so.

    The fold sees one row for each chunk, in order, because each cut depends on the one before; it holds no more than a
    batch of them, and its state is a dict of the stripe's bytes, rows and chunks.
    """
    fields = t.df.select(*t.columns).schema.fields
    total = sum((raw_size(f) for f in fields), F.lit(0).cast("long"))
    chunks = t.df.groupBy("chunk_id").agg(F.sum(total).alias("bytes"), F.count("*").alias("rows"))
    test = flush or (lambda state: state["bytes"] >= limit)

    def fold(parts):
        stripe, state = 0, {"bytes": 0, "rows": 0, "chunks": 0}
        for pdf in parts:
            out = []
            for size, rows in zip(pdf["bytes"], pdf["rows"], strict=True):
                out.append(stripe)
                state = {"bytes": state["bytes"] + int(size), "rows": state["rows"] + int(rows), "chunks": state["chunks"] + 1}
                if test(state):
                    stripe, state = stripe + 1, {"bytes": 0, "rows": 0, "chunks": 0}
            yield pdf[["chunk_id"]].assign(stripe=out)

    return chunks.repartition(1).sortWithinPartitions("chunk_id").mapInPandas(fold, "chunk_id long, stripe long")


def memory_policy(raw_limit: int, encoded_limit: int, factor: float, low: int = 0) -> Callable[[dict], bool]:
    """Ends a stripe at a raw size, or when its expected encoded size reaches a limit.

    low: once a stripe has ended at the raw size, further ones end at this lower size until one ends for its encoded size.
    """
    pressed = {"on": False}

    def test(state: dict) -> bool:
        if state["bytes"] / max(factor, 1.0) >= encoded_limit:
            pressed["on"] = False
            return True
        if state["bytes"] >= (low if pressed["on"] and low else raw_limit):
            pressed["on"] = bool(low)
            return True
        return False

    return test


def random_policy(seed: int, chance: float) -> Callable[[dict], bool]:
    """Ends stripes at random, for tests; the same seed cuts alike."""
    import random

    draw = random.Random(seed)
    return lambda state: draw.random() < chance


def shredded(df: DataFrame, row: str, column: str) -> DataFrame:
    """(key, row, value): a map column as one stream of values a key."""
    return df.select(row, F.explode(column).alias("key", "value")).select("key", row, "value")


def in_maps(df: DataFrame, row: str, column: str) -> DataFrame:
    """(key, present, rows, constant): how many rows hold each key; constant: all do, so the marks need not be kept."""
    total = df.agg(F.count("*").alias("rows"))
    keys = df.select(F.explode(F.map_keys(column)).alias("key")).groupBy("key").agg(F.count("*").alias("present"))
    return keys.crossJoin(F.broadcast(total)).withColumn("constant", F.col("present") == F.col("rows"))  # one row


def null_streams(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, nulls, kept): a column's nulls are kept only if there are some."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])
    return one.select(F.explode(parts).alias("s")).select("s.*").withColumn("kept", F.col("nulls") > 0)


def stream_order(columns: Sequence[str], features: dict[str, Sequence[str]] | None = None) -> list[str]:
    """The order of streams in a stripe: the row's nulls, the named features of map columns, then the schema's columns."""
    features = features or {}
    named = [f"{c}/{k}" for c in columns for k in features.get(c, ())]
    return ["nulls", *named, *columns]


def checksum(df: DataFrame) -> DataFrame:
    """(rows, checksum): a sum of row hashes, the same for any order of the rows."""
    h = F.xxhash64(*[F.col(c).cast("string") for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("checksum"))


def raw_bytes(df: DataFrame) -> DataFrame:
    """(column, bytes): each column's raw bytes."""
    one = df.agg(*[F.coalesce(F.sum(raw_size(f)), F.lit(0)).alias(f.name) for f in df.schema.fields])
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("bytes")) for c in df.columns])
    return one.select(F.explode(parts).alias("s")).select("s.*")


def write(df: DataFrame, path: str, keys: Sequence[str], options: WriterOptions | None = None) -> ColTable:
    """Lays df out by keys and writes it under path with sidecars: data, stripes, stats, and metadata with a checksum."""
    options = options or WriterOptions()
    t = ColTable.lay_out(df, keys, options.stripe_rows, options.chunk_rows)
    row = F.col("row_id")
    data = t.held.select(*t.columns, "row_id", F.floor(row / t.stripe_rows).cast("long").alias("stripe_id"), "_at")
    data.write.option("compression", options.compression).parquet(f"{path}/data")
    spark = df.sparkSession
    counts = [(p, t.starts[i + 1] - t.starts[i]) for i, p in enumerate(t.parts)]
    spark.createDataFrame(counts, "range long, rows long").coalesce(1).write.parquet(f"{path}/ranges")
    t.df.groupBy("stripe_id").agg(F.count("*").alias("rows")).write.parquet(f"{path}/stripes")
    stats.column_stats(t.df.select(*t.columns)).write.parquet(f"{path}/stats")
    pairs = {**options.user_metadata, "stripe_rows": str(options.stripe_rows), "chunk_rows": str(options.chunk_rows), "keys": ",".join(keys)}
    if options.checksum:
        pairs["checksum"] = checksum(t.df.select(*t.columns)).first()["checksum"]
    # Last, so that a table whose writing was cut short has no metadata and does not open.
    spark.createDataFrame(list(pairs.items()), "key string, value string").coalesce(1).write.parquet(f"{path}/metadata")
    return t


def abort(spark, path: str) -> None:
    """Removes what an unfinished write has left; a finished table is refused."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata/_SUCCESS")):
        raise ValueError(f"{path} is a finished table")
    system.delete(place, True)


def metadata(spark, path: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/metadata").collect()}


def verify(spark, path: str) -> bool:
    """Whether the data's checksum is the one written with it."""
    data = spark.read.parquet(f"{path}/data").drop("row_id", "stripe_id", "_at")
    return checksum(data).first()["checksum"] == metadata(spark, path).get("checksum")


def append(batch: DataFrame, path: str, epoch: int) -> None:
    """One more part of a table written part by part: a folder for each epoch, which a repeated one replaces.

    A table that ``write`` finished has row numbers, statistics and a checksum of all its rows, so it takes no parts.
    """
    spark = batch.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        raise ValueError(f"{path} is a finished table")
    batch.write.mode("overwrite").parquet(f"{path}/data/epoch={epoch}")


def bloom_bits(keys: int, per_key: int = 10) -> int:
    """Bits of a filter for that many keys, in whole blocks of 256."""
    return max(256, -(-keys * per_key // 256) * 256)


def bloom(df: DataFrame, key: str, bits: int, hashes: int = 8) -> DataFrame:
    """(block, mask): a split-block filter as 256-bit blocks; each key sets one bit in each of eight words of its block."""
    block = F.pmod(F.xxhash64(key), F.lit(bits // 256))
    marks = df.select(block.alias("block"), F.explode(F.array(*[_probe(key, i) for i in range(hashes)])).alias("bit")).distinct()
    word = F.floor(F.col("bit") / 32).cast("int")
    words = [F.coalesce(F.bit_or(F.when(word == i, F.expr("shiftleft(1L, cast(bit % 32 AS int))"))), F.lit(0)).alias(f"w{i}") for i in range(8)]
    return marks.groupBy("block").agg(*words)


def _probe(key: str, i: int) -> Column:
    return (F.lit(32 * i) + F.pmod(F.xxhash64(F.lit(i), F.col(key)), F.lit(32))).cast("int")


def may_hold(filter_blocks: DataFrame, probes: DataFrame, key: str, bits: int, hashes: int = 8) -> DataFrame:
    """probes with ``maybe``: false only for keys that were never added."""
    block = F.pmod(F.xxhash64(key), F.lit(bits // 256))
    joined = probes.withColumn("block", block).join(filter_blocks, "block", "left")
    found = F.lit(True)
    for i in range(hashes):
        bit = _probe(key, i)
        found = found & (F.coalesce(F.getbit(F.col(f"w{i}"), bit % 32), F.lit(0)) == 1)
    return joined.withColumn("maybe", found).select(*probes.columns, "maybe")


def compression_rate(spark, path: str) -> DataFrame:
    """(raw, stored, rate): raw bytes of a written table against those of its files."""
    data = spark.read.parquet(f"{path}/data").drop("row_id", "stripe_id", "_at")
    raw = raw_bytes(data).agg(F.sum("bytes").alias("raw"))
    stored = spark.read.format("binaryFile").load(f"{path}/data/*.parquet").agg(F.sum("length").alias("stored"))
    return raw.crossJoin(stored).withColumn("rate", F.col("raw") / F.col("stored"))  # two single rows
