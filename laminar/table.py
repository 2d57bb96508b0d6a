"""Row-addressed tables: a DataFrame laid out in key order, with row numbers, stripes and chunks.

Laying out range-partitions the rows by key once, sorts each range and writes it. Each written row carries its range and
its place there in one number, ``_at``, which grows with the row number; the ranges' row counts (as many as there are
shuffle partitions, or pieces of 32 MB in a large table) give row numbers without a sort of the whole table in one task,
and turn a range of row numbers into a range of ``_at`` that the Parquet reader prunes by.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laminar.sources.shared import materialize, scratch

_PLACE = 33  # bits of the place within a range
#: Bytes of Parquet that a range is made of, so that it is sorted in memory; a range's rows take several times as many.
RANGE_BYTES = 32 << 20
#: Of what is laid out: takes a third less than the session's default.
CODEC = "zstd"


class ColTable:
    """A laid-out table. ``df`` has the columns, ``row_id`` from 0, ``stripe_id`` and ``chunk_id`` (within the table)."""

    def __init__(self, held: DataFrame, counts: list[tuple[int, int]], keys: Sequence[str], stripe_rows: int, chunk_rows: int):
        self.keys, self.stripe_rows, self.chunk_rows = list(keys), stripe_rows, chunk_rows
        self._indexes: dict[tuple, DataFrame] = {}
        #: Of a written table that was opened: its path, and the pairs of its metadata.
        self.path: str | None = None
        self.about: dict[str, str] = {}
        self.columns = [c for c in held.columns if c != "_at"]
        self.parts = [p for p, _ in counts]
        self.starts = [0]
        for _, n in counts:
            self.starts.append(self.starts[-1] + n)
        self.n_rows = self.starts[-1]
        spark = held.sparkSession
        offsets = spark.createDataFrame(list(zip(self.parts, self.starts[:-1], strict=True)) or [(0, 0)], "_p long, _first long")
        # A row a range: as many as shuffle partitions, or one for each RANGE_BYTES of a large table.
        row = (F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << _PLACE) - 1))).cast("long")
        self.held = held.withColumn("_p", F.shiftright("_at", _PLACE)).join(F.broadcast(offsets), "_p").withColumn("row_id", row)

    @classmethod
    def lay_out(cls, df: DataFrame, keys: Sequence[str], stripe_rows: int = 10_000, chunk_rows: int = 1024, ranges: int = 0) -> ColTable:
        """Writes df in key order; keys should tell rows apart, or equal keys fall in the order of a checksum of their rows.

        The checksum parts the ranges too, so a key that many rows share is no single range. It is worked out where ranges
        and order need it and does not travel with the rows. ranges: how many at least, if more than shuffle partitions.
        """
        spark: SparkSession = df.sparkSession
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ranges)
        plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
        order = [*[F.col(k) for k in keys], *([F.xxhash64(*[F.col(c) for c in plain])] if plain else [])]
        ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
        path = scratch(spark, "table")
        ordered.write.parquet(path, compression=CODEC)
        held = spark.read.schema(ordered.schema).parquet(path)
        return cls(held, cls._counts(held), keys, stripe_rows, chunk_rows)

    @staticmethod
    def _counts(held: DataFrame) -> list[tuple[int, int]]:
        """(range, rows) of each range."""
        return sorted((r["p"], r["count"]) for r in held.groupBy(F.shiftright("_at", _PLACE).alias("p")).count().collect())

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> ColTable:
        """A table that ``laminar.sources.writer.write`` wrote: keys and sizes come from its metadata, rows from its data."""
        about = {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/metadata").collect()}
        if missing := {"keys", "stripe_rows", "chunk_rows"} - about.keys():
            raise ValueError(f"{path} is no written table: its metadata has no {', '.join(sorted(missing))}")
        held = spark.read.parquet(f"{path}/data").drop("row_id", "stripe_id")
        counts = sorted((r["range"], r["rows"]) for r in spark.read.parquet(f"{path}/ranges").collect())
        out = cls(held, counts, about["keys"].split(","), int(about["stripe_rows"]), int(about["chunk_rows"]))
        out.path, out.about = path, about
        return out

    def index(self, key: str, by: str = "chunk_id") -> DataFrame:
        """(part, first_key, last_key, start_row, rows) of each chunk or stripe; worked out and written once."""
        if (key, by) not in self._indexes:
            parts = self.df.groupBy(F.col(by).alias("part"))
            found = parts.agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.min("row_id").alias("start_row"), F.count("*").alias("rows"))
            self._indexes[key, by] = materialize(found, "index")
        return self._indexes[key, by]

    def _mark(self, row: int) -> int:
        """The ``_at`` of a row number, or one past all for numbers past the end."""
        i = bisect_right(self.starts, row) - 1
        if i >= len(self.parts):
            return (self.parts[-1] + 1 << _PLACE) if self.parts else 0
        return (self.parts[i] << _PLACE) + row - self.starts[i]

    @property
    def df(self) -> DataFrame:
        return self._view(self.held)

    def _view(self, held: DataFrame) -> DataFrame:
        row = F.col("row_id")
        return held.select(
            *self.columns, "row_id", F.floor(row / self.stripe_rows).cast("long").alias("stripe_id"), F.floor(row / self.chunk_rows).cast("long").alias("chunk_id")
        )

    def rows(self, start: int = 0, end: int | None = None) -> DataFrame:
        """The rows numbered start to end - 1; the bounds are clipped to the table."""
        start = min(max(start, 0), self.n_rows)
        end = self.n_rows if end is None else min(max(end, start), self.n_rows)
        held = self.held
        if start > 0:
            held = held.where(F.col("_at") >= self._mark(start))
        if end < self.n_rows:
            held = held.where(F.col("_at") < self._mark(end))
        return self._view(held)

    def stripe(self, s: int) -> DataFrame:
        return self.rows(s * self.stripe_rows, (s + 1) * self.stripe_rows) if s >= 0 else self.rows(0, 0)

    @property
    def n_stripes(self) -> int:
        return -(-self.n_rows // self.stripe_rows)

    def scan(self, columns: Sequence[str] | None = None, filters: Column | None = None, deleted: DataFrame | None = None) -> DataFrame:
        """Projected rows that pass the filters and whose row_id is not in ``deleted``."""
        df = self.df
        if deleted is not None:
            df = df.join(deleted.select("row_id").distinct(), "row_id", "left_anti")
        if filters is not None:
            df = df.where(filters)
        return df.select(*(columns or self.columns))

    def select(self, columns: Sequence[str] | None = None, limit: int = 20, offset: int = 0, stripe: int | None = None) -> DataFrame:
        """The named columns of at most limit rows after offset ones, of the table or of a stripe, in row order."""
        names = list(columns) if columns else self.columns
        if missing := [c for c in names if c not in self.columns]:
            raise KeyError(f"no column {missing[0]!r}; DESCRIBE lists the columns")
        first = 0 if stripe is None else stripe * self.stripe_rows
        last = self.n_rows if stripe is None else min(first + self.stripe_rows, self.n_rows)
        start = min(first + offset, last)
        return self.rows(start, min(start + limit, last)).orderBy("row_id").select(*names)

    def from_row(self, n: int) -> DataFrame:
        """Rows from number n on, which is clipped to the first and last row."""
        return self.rows(min(max(n, 0), max(self.n_rows - 1, 0)))

    def skip(self, n: int) -> tuple[DataFrame, int]:
        """Rows after the first n, and how many were skipped."""
        skipped = min(max(n, 0), self.n_rows)
        return self.rows(skipped), skipped


_CACHE: dict[tuple, ColTable] = {}


def _version(spark: SparkSession, path: str) -> tuple:
    """What changes when the files under a path do: their number, bytes and latest time of change."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.getContentSummary(place)
    inside = [x.getModificationTime() for x in system.listStatus(place)]
    return found.getFileCount(), found.getLength(), max(inside, default=0)


def cached(spark: SparkSession, path: str, keys: Sequence[str], stripe_rows: int = 10_000, chunk_rows: int = 1024) -> ColTable:
    """The table laid out from a Parquet path, once in an application and version of its files; ``forget`` drops all."""
    version = _version(spark, path)
    at = (spark.sparkContext.applicationId, path, version, tuple(keys), stripe_rows, chunk_rows)
    if at not in _CACHE:
        _CACHE[at] = ColTable.lay_out(spark.read.parquet(path), keys, stripe_rows, chunk_rows, -(-version[1] // RANGE_BYTES))
    return _CACHE[at]


def forget() -> None:
    _CACHE.clear()
