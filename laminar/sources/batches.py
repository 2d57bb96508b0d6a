"""Rows as self-contained binary batches, and back: whole, projected by column, or by range of rows.

A batch is an Arrow IPC stream of up to a fixed number of rows; a projection decodes only the wanted columns of each batch,
though its bytes are read whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BATCH = "task int, batch int, rows long, bytes long, data binary"


def serialize(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """(task, batch, rows, bytes, data): the rows of df in batches of at most ``rows``."""

    def run(parts):
        import pyarrow as pa
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        for part in parts:
            for at in range(0, part.num_rows, rows):
                own = part.slice(at, rows)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as out:
                    out.write_batch(own)
                data = sink.getvalue().to_pybytes()
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([k], pa.int32()), pa.array([own.num_rows], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], ["task", "batch", "rows", "bytes", "data"])
                k += 1

    return df.mapInArrow(run, BATCH)


def serialize_groups(df: DataFrame, group: str, order: str, rows: int) -> DataFrame:
    """As ``serialize``, with batches of at most ``rows`` rows of one group, in order within it.

    A batch is made of rows that a window numbers, so its rows do not depend on how tasks are cut.
    """
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    cut = df.withColumn("_batch", F.floor(place / rows).cast("long"))
    names = df.columns

    def run(keys, table):
        import pyarrow as pa

        own = table.select(names).sort_by(order).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema) as out:
            out.write_table(own)
        data = sink.getvalue().to_pybytes()
        head = [pa.array([0], pa.int32()), pa.array([keys[1].as_py()], pa.int32()), pa.array([own.num_rows], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())]
        return pa.Table.from_arrays(head, ["task", "batch", "rows", "bytes", "data"])

    return cut.groupBy(group, "_batch").applyInArrow(run, BATCH)


def deserialize(batches: DataFrame, schema: T.StructType, first: int = 0, count: int | None = None) -> DataFrame:
    """The rows of all batches; of each batch only ``count`` from row ``first`` on, if given."""
    return project(batches, schema, schema.fieldNames(), None, first, count)


def project(batches: DataFrame, schema: T.StructType, columns: Sequence[str], names: Sequence[str] | None = None, first: int = 0, count: int | None = None) -> DataFrame:
    """The named columns of all batches, renamed by position if names are given."""
    columns = list(columns)
    if missing := [c for c in columns if c not in schema.fieldNames()]:
        raise KeyError(f"no column {missing[0]!r}")
    out = T.StructType([T.StructField(n, schema[c].dataType, True) for c, n in zip(columns, names or columns, strict=True)])
    wanted = to_arrow_schema(out)

    return batches.select("data").mapInArrow(opener(columns, wanted, first, count), out)


def opener(columns: list[str], wanted, first: int, count: int | None):
    """What gives record batches of the wanted columns. Each stream is read where it lies, as the bytes of many come at once."""

    def run(parts):
        import pyarrow as pa

        for part in parts:
            for data in part.column(0):
                for own in pa.ipc.open_stream(data.as_buffer()):
                    kept = own.select(columns).slice(first, count)
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(kept.columns, wanted, strict=True)], schema=wanted)

    return run


def sizes(batches: DataFrame) -> DataFrame:
    """Smallest, largest, mean and total bytes and rows of the batches."""
    parts = [f(c).alias(f"{n}_{c}") for c in ("rows", "bytes") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg), ("total", F.sum))]
    return batches.agg(F.count("*").alias("batches"), *parts)
