"""Typed predicates, and the rule that turns them into bounds of an index's key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _range(c: Column, lower, upper, lower_open: bool, upper_open: bool, lit=F.lit) -> Column:
    parts = []
    if lower is not None:
        parts.append(c > lit(lower) if lower_open else c >= lit(lower))
    if upper is not None:
        parts.append(c < lit(upper) if upper_open else c <= lit(upper))
    return conjunction(parts) if parts else c.isNotNull()


def bigint_range(c, lower: int | None, upper: int | None) -> Column:
    return _range(_c(c), lower, upper, False, False)


def double_range(c, lower=None, upper=None, lower_open: bool = False, upper_open: bool = False) -> Column:
    """NaN is in no range that has a bound."""
    found = _range(_c(c), lower, upper, lower_open, upper_open, lambda v: F.lit(float(v)))
    return found & ~F.isnan(_c(c)) if upper is None and lower is not None else found


def bytes_range(c, lower=None, upper=None, lower_open: bool = False, upper_open: bool = False) -> Column:
    return _range(_c(c), lower, upper, lower_open, upper_open)


def bytes_values(c, values: Sequence) -> Column:
    return _c(c).isin(list(values))


def bool_value(c, value: bool) -> Column:
    return _c(c) == F.lit(value)


def _time(v) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{v}'")


def timestamp_range(c, lower=None, upper=None) -> Column:
    return _range(_c(c), lower, upper, False, False, _time)


def multi_range(c, ranges: Sequence[tuple]) -> Column:
    return reduce(lambda a, b: a | b, [timestamp_range(c, lo, hi) for lo, hi in ranges])


def is_null(c) -> Column:
    return _c(c).isNull()


def is_not_null(c) -> Column:
    return _c(c).isNotNull()


def or_null(predicate: Column, c) -> Column:
    return predicate | _c(c).isNull()


def conjunction(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates)


def by_dictionary(df: DataFrame, column: str, predicate: Column) -> DataFrame:
    """Tests each distinct value once, and keeps the rows that hold one that passed."""
    passed = df.select(column).distinct().where(predicate)
    return df.join(passed, column, "left_semi")


@dataclass(frozen=True)
class Range:
    """A range filter; open sides exclude their bound, and None is unbounded."""

    lower: object = None
    upper: object = None
    lower_open: bool = False
    upper_open: bool = False
    null_allowed: bool = False

    def condition(self, name: str) -> Column:
        found = _range(F.col(name), self.lower, self.upper, self.lower_open, self.upper_open)
        if self.upper is None and isinstance(self.lower, (int, float)):  # NaN is above all numbers, and in no range
            found = found & ~F.isnan(F.col(name).cast("double"))
        return or_null(found, name) if self.null_allowed else found

    @property
    def point(self):
        same = self.lower is not None and self.lower == self.upper and not (self.lower_open or self.upper_open)
        return (self.lower,) if same and not self.null_allowed else None


@dataclass(frozen=True)
class Values:
    """A filter of listed values."""

    values: Sequence
    null_allowed: bool = False

    def condition(self, name: str) -> Column:
        found = bytes_values(name, self.values)
        return or_null(found, name) if self.null_allowed else found

    @property
    def point(self):
        return (self.values[0],) if len(self.values) == 1 and not self.null_allowed else None


@dataclass
class Bounds:
    """The key columns that a lookup is bound by, with each side's values in key order, and the filters left over."""

    columns: list[str] = field(default_factory=list)
    lower: list = field(default_factory=list)
    upper: list = field(default_factory=list)
    used: dict = field(default_factory=dict)
    left: dict = field(default_factory=dict)

    def condition(self) -> Column:
        return conjunction([f.condition(n) for n, f in self.used.items()]) if self.used else F.lit(True)

    def rest(self) -> Column:
        return conjunction([f.condition(n) for n, f in self.left.items()]) if self.left else F.lit(True)


def to_bounds(key_columns: Sequence[str], ascending: Sequence[bool], filters: dict, strings: Sequence[str] = ()) -> Bounds | None:
    """The longest prefix of the key that filters bind: points, and at most one range at its end. None if it is empty.

    Filters that allow null, or list several values, bind nothing; in a descending column the sides change places, and a
    descending string column (named in ``strings``) ends the prefix.
    """
    out = Bounds(left=dict(filters))
    for name, up in zip(key_columns, ascending, strict=True):
        f = filters.get(name)
        if f is None or f.null_allowed or (not up and name in strings):
            break
        if f.point is not None:
            low = high = f.point[0]
        elif isinstance(f, Range):
            low, high = (f.lower, f.upper) if up else (f.upper, f.lower)
        else:
            break
        out.columns.append(name)
        out.lower.append(low)
        out.upper.append(high)
        out.used[name] = out.left.pop(name)
        if f.point is None:
            break
    return out if out.columns else None
