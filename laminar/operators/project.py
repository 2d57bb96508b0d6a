"""Projections: nested fields, keys of maps, and parts of complex values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def subfields(df: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Columns and nested fields, named by their last part; only they are read."""
    return df.select(*[F.col(p).alias(p.rsplit(".", 1)[-1]) for p in paths])


def keys(df: DataFrame, column: str, names: Sequence, mode: str = "include", as_struct: bool = False) -> DataFrame:
    """A map column with the named keys alone, or without them; as a struct, a field for each name, null if missing."""
    names = list(names)
    if as_struct:
        if mode != "include" or not names:
            raise ValueError("a struct needs the keys that it includes")
        return df.withColumn(column, F.when(F.col(column).isNotNull(), F.struct(*[F.try_element_at(F.col(column), F.lit(k)).alias(str(k)) for k in names])))
    listed = F.array(*[F.lit(k) for k in names]) if names else None
    if listed is None:
        return df if mode == "exclude" else df.withColumn(column, F.map_filter(column, lambda k, v: F.lit(False)))
    test = (lambda k, v: F.array_contains(listed, k)) if mode == "include" else (lambda k, v: ~F.array_contains(listed, k))
    return df.withColumn(column, F.map_filter(column, test))


def extract(column: str, what: str, arg=None) -> Column:
    """Part of a complex value: keys, values, size, the entries of some keys, or a field."""
    c = F.col(column)
    if what == "keys":
        return F.map_keys(c)
    if what == "values":
        return F.map_values(c)
    if what == "size":
        return F.when(c.isNotNull(), F.size(c)).cast("long")
    if what == "filter":
        return F.map_filter(c, lambda k, v: k.isin(list(arg)))
    if what == "field":
        return c[arg]
    raise ValueError(f"no extraction {what!r}")


def _field(name: str):
    return lambda x: x[name]


def chain(column: str, steps: Sequence[tuple[str, object]]) -> Column:
    """Extractions one after another; ``element_field`` takes a field of each element."""
    out = F.col(column)
    for what, arg in steps:
        if what == "values":
            out = F.map_values(out)
        elif what == "keys":
            out = F.map_keys(out)
        elif what == "field":
            out = out[arg]
        elif what == "element_field":
            out = F.transform(out, _field(arg))
        elif what == "size":
            out = F.size(out).cast("long")
        else:
            raise ValueError(f"no extraction {what!r}")
    return out


def shred(df: DataFrame, row: str, column: str) -> DataFrame:
    """A map column as rows (row, key, value), one for each entry."""
    return df.select(row, F.explode(column).alias("key", "value"))


def merge(rows: DataFrame, row: str, key: str, value: str, out: str = "m") -> DataFrame:
    """Rows of entries as a map column again, by row, with keys in order."""
    return rows.groupBy(row).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(out))


def pivot(rows: DataFrame, row: str, names: Sequence) -> DataFrame:
    """Entries (row, key, value) as one column for each named key."""
    return rows.groupBy(row).agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(str(k)) for k in names])


def omit_keys(df: DataFrame, index_keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A projection of a table whose index keys are held by the index alone: naming one is an error."""
    if bad := [c for c in columns if c in index_keys]:
        raise ValueError(f"{bad[0]} is held by the index alone and cannot be read")
    return df.drop(*index_keys).select(*columns)
