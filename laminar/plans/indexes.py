"""Kinds of index by name: what builds one over a table, and what looks rows up in it. Others can be registered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from laminar.operators import lookup, scan
from laminar.table import ColTable


@dataclass(frozen=True)
class IndexKind:
    """build(table, key) gives the index's rows; points and ranges (or None) answer requests with row ranges."""

    build: Callable[[ColTable, str], DataFrame]
    points: Callable[[ColTable, DataFrame, str], DataFrame] | None = None
    ranges: Callable[[ColTable, DataFrame, str], DataFrame] | None = None


_KINDS: dict[str, IndexKind] = {}


def register(name: str, kind: IndexKind) -> None:
    if name in _KINDS:
        raise ValueError(f"there is an index kind {name!r}")
    _KINDS[name] = kind


def kind(name: str) -> IndexKind:
    if name not in _KINDS:
        raise KeyError(f"no index kind {name!r}; there are {', '.join(sorted(_KINDS))}")
    return _KINDS[name]


def _ranges(t: ColTable, requests: DataFrame, key: str) -> DataFrame:
    return lookup.range_rows(t, requests, key, [])


register("cluster", IndexKind(lambda t, key: lookup.bounds(t, key), lookup.point_ranges, _ranges))
register("hash", IndexKind(lambda t, key: lookup.HashIndex(t, key).entries, lambda t, requests, key: lookup.HashIndex(t, key).hits(requests)))
register("sorted", IndexKind(scan.secondary, lambda t, requests, key: lookup.SortedIndex(t, key).points(requests), lambda t, requests, key: lookup.SortedIndex(t, key).ranges(requests)))
