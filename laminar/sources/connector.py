"""Reading a written table by ``spark.read.format("laminar")``: a Python data source, one partition a data file.

``register(spark)`` once; ``load(path)`` reads what ``laminar.sources.writer.write`` wrote. Equality and range filters that
Spark pushes are applied to each file's rows as they are read, and files that their statistics rule out are passed over.
For columns alone, ``spark.read.parquet(f"{path}/data")`` prunes better; the data source API has no hook for projections.
"""

from __future__ import annotations

from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.pandas.types import from_arrow_schema

_OPERATORS = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _dataset(path: str, files: list[str] | None = None):
    import pyarrow.dataset as ds
    from pyarrow import fs

    # Without a scheme a path is one of Spark's default file system, which the workers that run this do not know.
    if "://" not in path:
        raise ValueError(f"the path needs a scheme, as in file://{path}")
    scheme, mark, rest = path.partition("://")
    system, place = fs.FileSystem.from_uri(f"s3{mark}{rest}" if scheme in ("s3a", "s3n") else path)
    return ds.dataset(files or f"{place}/data", format="parquet", filesystem=system)


class File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class LaminarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "laminar"

    def schema(self):
        return from_arrow_schema(_dataset(self.options["path"]).schema)

    def reader(self, schema):
        return LaminarReader(self.options["path"])


class LaminarReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _OPERATORS and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)):
                self.filters.append((f.attribute[0], _OPERATORS[type(f)], f.value))
            else:
                yield f

    def partitions(self):
        return [File(f) for f in _dataset(self.path).files]

    def read(self, partition):
        import operator

        import pyarrow.compute as pc

        made = {"==": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
        keep = None
        for column, op, value in self.filters:
            test = made[op](pc.field(column), value)
            keep = test if keep is None else keep & test
        yield from _dataset(self.path, [partition.path]).to_batches(filter=keep)


def register(spark) -> None:
    """Makes the format known to the session, and lets Python sources see filters, which is off by default."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LaminarSource)
