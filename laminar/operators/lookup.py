"""Lookups by key: points and ranges in batches, with limits, residual filters, misses, and keys to resume by.

Requests are a DataFrame with ``request_id`` and the bounds; upper bounds are exclusive. Joins are equality joins, left to
the optimizer, which broadcasts a side only where it knows it to be small. The least and greatest key of a batch go to the
reader as filters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laminar.operators.scan import raw_size, with_starts
from laminar.sources.shared import materialize, scratch
from laminar.sources.writer import bloom, bloom_bits, may_hold
from laminar.table import ColTable


def within(rows: DataFrame, key: str, asked: DataFrame, low: str, high: str) -> DataFrame:
    """rows whose key lies between the least and the greatest that is asked for: bounds that the reader prunes by.

    A null bound leaves its side open.
    """
    ends = asked.agg(F.min(low).alias("lo"), F.max(high).alias("hi"), F.count_if(F.col(low).isNull()).alias("below"), F.count_if(F.col(high).isNull()).alias("above")).first()
    if not ends["below"] and ends["lo"] is not None:
        rows = rows.where(F.col(key) >= F.lit(ends["lo"]))
    if not ends["above"] and ends["hi"] is not None:
        rows = rows.where(F.col(key) <= F.lit(ends["hi"]))
    return rows


def point_ranges(t: ColTable, requests: DataFrame, key: str) -> DataFrame:
    """(request_id, start_row, end_row): the rows of each requested key in a table sorted by it; misses are left out."""
    rows = within(t.df, key, requests.where(F.col("key").isNotNull()), "key", "key")
    hits = requests.join(rows.select(F.col(key).alias("_k"), "row_id"), F.col("key") == F.col("_k"))
    return hits.groupBy("request_id").agg(F.min("row_id").alias("start_row"), (F.max("row_id") + 1).alias("end_row"))


def bounds(t: ColTable, key: str, by: str = "stripe_id") -> DataFrame:
    """(part, first_key, last_key, start_row, rows) of each stripe or chunk: what pruning looks at."""
    return t.index(key, by)


def located(t: ColTable, requests: DataFrame, key: str) -> DataFrame:
    """requests (lo, hi) with ``first_part`` and ``last_part``: the chunks of a table sorted by key that may hold their keys.

    Requests without such chunks are left out. Chunks follow each other in key order, so both ends are searched for, not
    compared with all chunks: halving a literal list of the ends of runs of chunks, no longer than there are shuffle
    partitions, gives the run, and one sweep over the run's chunks and the distinct bounds that fall in it gives the chunk.
    Bounds on or beyond the table's ends need no search, however many there are. The sweep goes on from what came before
    in its order, as a frame that reaches to the end is gone through again for each row.
    """
    parts = t.index(key).select("part", "first_key", "last_key")
    n_chunks = -(-t.n_rows // t.chunk_rows)
    per = -(-n_chunks // int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))) or 1
    run = F.floor(F.col("part") / per).cast("int")
    grouped = parts.where(F.col("first_key").isNotNull()).groupBy(run.alias("run")).agg(F.min("first_key").alias("a"), F.max("last_key").alias("z"), F.min("part").alias("p"))
    ends = sorted((r["run"], r["a"], r["z"], r["p"]) for r in grouped.collect())
    if not ends:
        return requests.where("false").withColumns({"first_part": F.lit(0).cast("long"), "last_part": F.lit(0).cast("long")})
    least, greatest = F.lit(ends[0][1]), F.lit(ends[-1][2])

    def swept(bound: str, values: list, back: int, end: str, out: str) -> DataFrame:
        """The chunk of each bound between the table's ends; runs are those of ``ends``, whose numbers may have gaps."""
        place = places_below(F.col("k"), values) - back
        asked = requests.select(F.col(bound).alias("k")).where((F.col("k") > least) & (F.col("k") <= greatest)).distinct()
        asked = asked.withColumn("run", F.get(F.array(*[F.lit(r) for r, *_ in ends]), place)).select("run", "k", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("part"))
        both = asked.unionByName(parts.select(run.alias("run"), F.col(end).alias("k"), F.lit(1).alias("kind"), "part"))
        order = [F.desc(c) if out == "first_part" else F.asc(c) for c in ("k", "kind", "part")]
        sofar = Window.partitionBy("run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = both.withColumn(out, F.last("part", ignorenulls=True).over(sofar))
        return found.where("kind = 0").select(F.col("k").alias(f"_{bound}"), out).where(F.col(out).isNotNull())

    first = swept("lo", [z for _, _, z, _ in ends], 0, "last_key", "first_part")
    last = swept("hi", [a for _, a, _, _ in ends], 1, "first_key", "last_part")
    met = requests.where((F.col("lo").isNull() | (F.col("lo") <= greatest)) & (F.col("hi").isNull() | (F.col("hi") > least)))
    asked = met.join(first, F.col("lo") == F.col("_lo"), "left").join(last, F.col("hi") == F.col("_hi"), "left")
    low = F.when(F.col("lo").isNull(), F.lit(0)).when(F.col("lo") <= least, F.lit(ends[0][3])).otherwise(F.col("first_part"))
    high = F.when(F.col("hi").isNull() | (F.col("hi") > greatest), F.lit(n_chunks - 1)).otherwise(F.col("last_part"))
    out = asked.drop("_lo", "_hi").withColumns({"first_part": low.cast("long"), "last_part": high.cast("long")})
    return out.where("first_part <= last_part")


def places_below(x: Column, values: Sequence) -> Column:
    """How many of ``values``, which are in order, are less than x: by halving."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(values).bit_length()))])
    held = F.array(*[F.lit(v) for v in values])
    return F.aggregate(steps, F.lit(0), lambda s, p: F.when(F.get(held, s + p - 1) < x, s + p).otherwise(s))


def pruned(t: ColTable, requests: DataFrame, key: str) -> DataFrame:
    """(request_id, part): the chunks that may hold keys in [lo, hi) of a request."""
    near = located(t, requests, key)
    return near.select("request_id", F.explode(F.sequence("first_part", "last_part")).alias("part"))


def range_rows(t: ColTable, requests: DataFrame, key: str, columns: Sequence[str], filters: Column | None = None) -> DataFrame:
    """Rows with key in [lo, hi) of each request; a null bound is open, and a range that ends before it starts is empty.

    The requests are located in the chunks that may hold their keys, so rows are compared with the requests of their chunk
    alone: an equality join on the chunk.
    """
    asked = requests.where(F.col("lo").isNull() | F.col("hi").isNull() | (F.col("lo") < F.col("hi")))
    near = located(t, asked.select("request_id", "lo", "hi"), key).withColumn("chunk_id", F.explode(F.sequence("first_part", "last_part")))
    rows = within(t.df if filters is None else t.df.where(filters), key, asked, "lo", "hi")
    inside = (F.col("lo").isNull() | (F.col(key) >= F.col("lo"))) & (F.col("hi").isNull() | (F.col(key) < F.col("hi")))
    return near.drop("first_part", "last_part").join(rows, "chunk_id").where(inside).select("request_id", "row_id", *columns)


def capped(hits: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of each request, the first by row; 0: all. Each task drops what is past the cap first."""
    if not most:
        return hits
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("row_id"))
    return hits.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def batch_lookup(t: ColTable, requests: DataFrame, key: str, columns: Sequence[str], filters: Column | None = None, max_rows_per_request: int = 0) -> DataFrame:
    """(request_id, row_id, columns) of each requested key's rows; the cap counts rows that pass the filters."""
    asked = requests.where(F.col("key").isNotNull()).select("request_id", F.col("key").alias("_key"))
    rows = within(t.df if filters is None else t.df.where(filters), key, asked, "_key", "_key")
    hits = asked.join(rows, F.col("_key") == F.col(key)).select("request_id", "row_id", *columns)
    return capped(hits, max_rows_per_request)


def batch_lookup_clipped(t: ColTable, ranges: DataFrame, columns: Sequence[str], max_rows_per_request: int) -> DataFrame:
    """Rows of row ranges that are clipped before they are read, as lookups without filters do."""
    end = F.least("end_row", F.col("start_row") + max_rows_per_request)
    clipped = ranges.where(F.col("end_row") > F.col("start_row")).select("request_id", F.explode(F.sequence(F.col("start_row"), end - 1)).alias("row_id"))
    return clipped.join(t.df, "row_id").select("request_id", "row_id", *columns)


def misses(requests: DataFrame, df: DataFrame, key: str) -> DataFrame:
    return requests.join(df.select(F.col(key).alias("key")), "key", "left_anti")


def hits(requests: DataFrame, df: DataFrame, key: str) -> DataFrame:
    return requests.join(df.select(F.col(key).alias("key")), "key", "left_semi")


def project_lookup(t: ColTable, requests: DataFrame, key: str, columns: Sequence[str], max_rows_per_request: int) -> tuple[DataFrame, DataFrame]:
    """(rows, resume keys): rows of range requests [lo, hi) up to the cap, and the key that each cut request goes on at."""
    found = range_rows(t, requests, key, [key, *[c for c in columns if c != key]])
    order = Window.partitionBy("request_id").orderBy("row_id")
    placed = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_rows_per_request + 1)
    rows = placed.where(F.col("_n") <= max_rows_per_request).select("request_id", "row_id", *columns)
    return rows, placed.where(F.col("_n") == max_rows_per_request + 1).select("request_id", F.col(key).alias("resume_key"))


def soft_limit(t: ColTable, hit_rows: DataFrame, max_rows: int = 0, max_bytes: int = 0, size: Column | None = None) -> DataFrame:
    """Rows of whole stripes, in order, up to and with the stripe in which a limit is reached; 0: no limit.

    size: a row's bytes; by default the raw ones of the columns that the hits have.
    """
    stripe = F.floor(F.col("row_id") / t.stripe_rows).cast("long")
    if size is None:
        size = sum((raw_size(f) for f in hit_rows.schema.fields if f.name not in ("request_id", "row_id")), F.lit(0).cast("long"))
    counts = hit_rows.groupBy(stripe.alias("_s")).agg(F.count("*").alias("_c"), F.sum(size).alias("_b"))
    placed = with_starts(with_starts(counts, "_s", "_c", "_rows"), "_s", "_b", "_bytes")
    open_ = F.lit(True)
    if max_rows:
        open_ = open_ & (F.col("_rows") < max_rows)
    if max_bytes:
        open_ = open_ & (F.col("_bytes") < max_bytes)
    return hit_rows.withColumn("_s", stripe).join(placed.where(open_).select("_s"), "_s", "left_semi").drop("_s")


def key_at(t: ColTable, row: int, key: str) -> DataFrame:
    return t.rows(row, row + 1).select("row_id", F.col(key).alias("key"))


def row_parts(t: ColTable, rows: DataFrame) -> DataFrame:
    """(row_id, stripe_id, chunk_id, row in chunk) of row numbers, by arithmetic on the fixed sizes."""
    r = F.col("row_id")
    stripe, chunk = F.floor(r / t.stripe_rows).cast("long"), F.floor(r / t.chunk_rows).cast("long")
    return rows.where((r >= 0) & (r < t.n_rows)).select("row_id", stripe.alias("stripe_id"), chunk.alias("chunk_id"), (r % t.chunk_rows).alias("row_in_chunk"))


class HashIndex:
    """A point index: entries (key, row_id) in hash buckets, written by bucket, with the least and greatest key and a filter.

    A lookup passes over keys outside the ends and those that the filter has never seen, and reads the buckets of the rest.
    """

    def __init__(self, t: ColTable, key: str, buckets: int = 64):
        self.t, self.key, self.buckets = t, key, buckets
        rows = t.df.where(F.col(key).isNotNull()).select(self._bucket(F.col(key)).alias("bucket"), F.col(key).alias("key"), "row_id")
        path = scratch(rows.sparkSession, "hash-index")
        rows.repartition("bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(path)
        schema = rows.select("key", "row_id", "bucket").schema
        self.entries = rows.sparkSession.read.schema(schema).parquet(path)
        ends = self.entries.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count_distinct("key").alias("n")).first()
        self.lo, self.hi, self.bits = ends["lo"], ends["hi"], bloom_bits(ends["n"])
        self.filter = materialize(bloom(self.entries, "key", self.bits), "bloom")

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def stats(self) -> DataFrame:
        """(bucket, keys, rows, lo, hi) of each bucket that has entries."""
        return self.entries.groupBy("bucket").agg(F.count_distinct("key").alias("keys"), F.count("*").alias("rows"), F.min("key").alias("lo"), F.max("key").alias("hi"))

    def marked(self, requests: DataFrame) -> DataFrame:
        """requests (request_id, key) with ``skip``: 'range' or 'filter' for keys that need not be looked up, else null."""
        out = (F.col("key") < F.lit(self.lo)) | (F.col("key") > F.lit(self.hi)) if self.lo is not None else F.lit(True)
        probed = may_hold(self.filter, requests, "key", self.bits)
        return probed.withColumn("skip", F.when(F.coalesce(out, F.lit(True)), "range").when(~F.col("maybe"), "filter")).drop("maybe")

    def hits(self, requests: DataFrame) -> DataFrame:
        """(request_id, row_id) of each requested key."""
        left = self.marked(requests).where("skip IS NULL").withColumn("bucket", self._bucket(F.col("key")))
        return left.join(self.entries, ["bucket", "key"]).select("request_id", "row_id")

    def rows(self, requests: DataFrame, columns: Sequence[str]) -> DataFrame:
        """(request_id, row_id, columns) of each requested key's rows, fetched by row number."""
        found = materialize(self.hits(requests), "hits")
        return found.join(between_rows(self.t, found), "row_id").select("request_id", "row_id", *columns)

    def counters(self, requests: DataFrame) -> DataFrame:
        """(lookups, range_skips, filter_skips, misses, matched) of a batch; misses: looked up in vain."""
        marked = self.marked(requests).withColumn("bucket", self._bucket(F.col("key")))
        held = self.entries.groupBy("bucket", "key").agg(F.count("*").alias("c"))
        met = marked.join(held, ["bucket", "key"], "left")
        range_, filter_ = F.coalesce(F.col("skip") == "range", F.lit(False)), F.coalesce(F.col("skip") == "filter", F.lit(False))
        missed = F.col("skip").isNull() & F.col("c").isNull()
        return met.agg(F.count("*").alias("lookups"), F.count_if(range_).alias("range_skips"), F.count_if(filter_).alias("filter_skips"), F.count_if(missed).alias("misses"), F.coalesce(F.sum("c"), F.lit(0)).alias("matched"))


class SortedIndex:
    """A secondary index: entries (key, row) in key order, themselves a table laid out by key, searched as one is."""

    def __init__(self, t: ColTable, key: str):
        self.t, self.key = t, key
        rows = t.df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col("row_id").alias("row"))
        self.entries = ColTable.lay_out(rows, ["key", "row"], t.stripe_rows, t.chunk_rows, len(t.parts))

    def points(self, requests: DataFrame) -> DataFrame:
        """(request_id, row_id) of requested keys."""
        return batch_lookup(self.entries, requests, "key", ["row"]).select("request_id", F.col("row").alias("row_id"))

    def ranges(self, requests: DataFrame) -> DataFrame:
        """(request_id, row_id) of keys in [lo, hi)."""
        return range_rows(self.entries, requests, "key", ["row"]).select("request_id", F.col("row").alias("row_id"))

    def rows(self, hits: DataFrame, columns: Sequence[str]) -> DataFrame:
        """(request_id, row_id, columns) of hits, fetched by row number."""
        found = materialize(hits, "hits")
        return found.join(between_rows(self.t, found), "row_id").select("request_id", "row_id", *columns)


def between_rows(t: ColTable, hits: DataFrame) -> DataFrame:
    """The table's rows between the first and the last that hits name: a range that the reader prunes by."""
    ends = hits.agg(F.min("row_id").alias("a"), F.max("row_id").alias("z")).first()
    return t.rows(0, 0) if ends["a"] is None else t.rows(ends["a"], ends["z"] + 1)


def lookup_counters(t: ColTable, requests: DataFrame, key: str) -> DataFrame:
    """(lookups, range_skips, misses, matched): how a batch of points fares against the table's smallest and largest key."""
    ends = t.index(key).agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi")).first()
    asked = requests.withColumn("out", F.coalesce((F.col("key") < F.lit(ends["lo"])) | (F.col("key") > F.lit(ends["hi"])), F.lit(True)))
    rows = within(t.df, key, requests.where(F.col("key").isNotNull()), "key", "key").groupBy(F.col(key).alias("key")).agg(F.count("*").alias("c"))
    met = asked.join(rows, "key", "left")
    return met.agg(F.count("*").alias("lookups"), F.count_if("out").alias("range_skips"), F.count_if(~F.col("out") & F.col("c").isNull()).alias("misses"), F.coalesce(F.sum("c"), F.lit(0)).alias("matched"))
