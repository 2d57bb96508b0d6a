"""How encodings are picked: by cost, by a given function of the statistics, by replaying a layout, from a memo, at random.

A policy takes a table's rows and columns and gives (column, stripe_id, encoding, size), as ``advisor.choose_all`` does.
Layouts are JSON text, column to encoding, so they can be kept with a table and replayed on another.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminar.operators import advisor

Policy = Callable[[DataFrame, Sequence[str]], DataFrame]


def _sized(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [advisor.estimates(rows, c).withColumn("column", F.lit(c)) for c in columns])


def cost_based(factors: dict[str, float] | None = None) -> Policy:
    return lambda rows, columns: advisor.choose_all(rows, columns, factors=factors)


def learned(score: Callable[[Column, Column], Column]) -> Policy:
    """Picks the least ``score(encoding, size)``, an expression that a model was turned into."""

    def pick(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        best = F.min(F.struct(score(F.col("encoding"), F.col("size")).alias("s"), "place", "encoding", "size")).alias("b")
        return _sized(rows, columns).groupBy("column", "stripe_id").agg(best).select("column", "stripe_id", "b.encoding", "b.size")

    return pick


def capture(chosen: DataFrame) -> str:
    """The layout of chosen encodings: for each column the one of most stripes, the first by name on ties."""
    counts = chosen.groupBy("column", "encoding").agg(F.count("*").alias("n"))
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "encoding")).alias("b"))
    return json.dumps({r["column"]: r["b"]["encoding"] for r in best.collect()}, sort_keys=True)  # a row a column


def replayed(layout: str) -> Policy:
    """Uses the layout's encodings where they can be used, and the cheapest elsewhere."""
    wanted = json.loads(layout)

    def pick(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        known = F.create_map(*[x for c, e in wanted.items() for x in (F.lit(c), F.lit(e))]) if wanted else None
        sized = _sized(rows, columns)
        first = (F.col("encoding") != F.try_element_at(known, F.col("column"))) if known is not None else F.lit(True)
        factor = F.create_map(*[x for e, f in advisor.READ_FACTORS.items() for x in (F.lit(e), F.lit(f))])
        best = F.min(F.struct(F.coalesce(first, F.lit(True)).alias("other"), (F.col("size") * factor[F.col("encoding")]).alias("cost"), "place", "encoding", "size")).alias("b")
        return sized.groupBy("column", "stripe_id").agg(best).select("column", "stripe_id", "b.encoding", "b.size")

    return pick


def remembered(policy: Policy, memo: dict[str, str]) -> Policy:
    """Picks once for each column, and replays what was picked from then on."""

    def pick(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        if new := [c for c in columns if c not in memo]:
            memo.update(json.loads(capture(policy(rows, new))))
        return replayed(json.dumps(memo))(rows, columns)

    return pick


def random_choice(seed: int) -> Policy:
    """Any usable encoding, by a hash of the seed: for tests."""
    return learned(lambda encoding, size: F.xxhash64(F.lit(seed), encoding, size))
