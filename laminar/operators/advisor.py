"""Which encoding suits a column of a stripe: estimated sizes from statistics, and the cheapest by size and read cost.

Estimates are bytes of encoded streams, by closed formulas over a group's statistics; nothing is encoded. Values of
integers are taken as unsigned of their width, as the codecs do, so that a column of mixed signs has a wide range, and
doubles and floats by their bits.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laminar.functions.scalar import double_bits
from laminar.operators import stats

#: Bytes before each encoded stream, and what reading each encoding costs for its size, in order of trial.
PREFIX = 6
READ_FACTORS = {
    "Constant": 1.0, "Trivial": 0.7, "FixedBitWidth": 0.9, "MainlyConstant": 1.0, "SparseBool": 1.0, "Dictionary": 1.0, "RLE": 1.0, "Varint": 1.0,
}
WIDTHS = {"byte": 1, "short": 2, "integer": 4, "long": 8, "float": 4, "double": 8, "timestamp": 8, "timestamp_ntz": 8}


def parse_read_factors(text: str) -> dict[str, float]:
    """``E=f;E=f`` to a table in that order; an unknown name or a factor that is no number is an error."""
    out: dict[str, float] = {}
    for part in filter(None, (p.strip() for p in text.split(";"))):
        name, eq, value = part.partition("=")
        if not eq or name.strip() not in READ_FACTORS:
            raise ValueError(f"no encoding and factor: {part!r}")
        out[name.strip()] = float(value)
    return out


def _n(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def packed(n, span, width: int) -> Column:
    """Values of a range packed at whole bytes each: header, baseline, data."""
    bits = F.when(span <= 0, 1).otherwise(F.ceil(F.log2(span.cast("double") + 1)))
    exact = F.when(span < (1 << 52), F.length(F.bin(F.greatest(span, F.lit(0)).cast("long")))).otherwise(bits)
    return F.lit(PREFIX + 2 + width) + F.ceil(F.ceil(exact / 8) * 8 * _n(n) / 8)


def packed_u32(n, lo, hi) -> Column:
    return packed(n, (_n(hi) - _n(lo)).cast("long"), 4)


def trivial(n, width: int) -> Column:
    return F.lit(PREFIX + 1) + _n(n) * width


def trivial_strings(n, total, lo, hi) -> Column:
    return F.lit(PREFIX + 5) + _n(total) + packed_u32(n, lo, hi)


def sparse_bool(n, k) -> Column:
    return F.lit(PREFIX + 1) + packed_u32(_n(k) + 1, 0, n)


def numeric_estimates(width: int) -> dict[str, Column]:
    """Estimates over a group's facts: n, ndv, span, runs, min_run, max_run, mode_n, varint_bytes. None: not usable."""
    n, ndv, span = F.col("n"), F.col("ndv"), F.col("span")
    rest = n - F.col("mode_n")
    out = {
        "Constant": F.when(ndv == 1, F.lit(PREFIX + width)),
        "Trivial": trivial(n, width),
        "FixedBitWidth": packed(n, span, width),
        "MainlyConstant": F.lit(PREFIX + 8 + width) + packed(rest, span, width) + sparse_bool(n, rest),
        "Dictionary": packed_u32(n, 0, ndv - 1) + F.least(trivial(ndv, width), packed(ndv, span, width)) + PREFIX + 4,
        "RLE": F.lit(PREFIX + 4) + packed_u32(F.col("runs"), F.col("min_run"), F.col("max_run")) + packed(F.col("runs"), span, width),
    }
    if width >= 4:
        out["Varint"] = F.lit(PREFIX + width) + F.col("varint_bytes")
    return out


def string_estimates() -> dict[str, Column]:
    """Over n, ndv, total, uniq_total, min_len, max_len, runs, min_run, max_run, mode_n, mode_len, rest_min, rest_max."""
    n, ndv = F.col("n"), F.col("ndv")
    lo, hi, uniq = F.col("min_len"), F.col("max_len"), F.col("uniq_total")
    alphabet = trivial_strings(ndv, uniq, lo, hi)
    rest = trivial_strings(ndv - 1, uniq - F.col("mode_len"), F.coalesce("rest_min", F.lit(0)), F.coalesce("rest_max", F.lit(0)))
    run_values = packed_u32(F.col("runs"), 0, ndv - 1) + alphabet + PREFIX + 4
    return {
        "Constant": F.when(ndv == 1, hi + PREFIX + 4),
        "Trivial": trivial_strings(n, F.col("total"), lo, hi),
        "MainlyConstant": F.lit(PREFIX + 12) + F.col("mode_len") + rest + sparse_bool(n, n - F.col("mode_n")),
        "Dictionary": packed_u32(n, 0, ndv - 1) + alphabet + PREFIX + 4,
        "RLE": F.lit(PREFIX + 4) + packed_u32(F.col("runs"), F.col("min_run"), F.col("max_run")) + run_values,
    }


def bool_estimates() -> dict[str, Column]:
    n, ones = F.col("n"), F.col("ones")
    return {
        "Constant": F.when(F.col("ndv") == 1, F.lit(PREFIX + 1)),
        "Trivial": F.lit(PREFIX + 1 + 7) + F.ceil(n / 8),
        "SparseBool": sparse_bool(n, F.least(ones, n - ones)),
        "RLE": F.lit(PREFIX + 4 + 1) + packed_u32(F.col("runs"), F.col("min_run"), F.col("max_run")),
    }


def unsigned(c: Column, width: int) -> Column:
    """A signed integer as the unsigned one of the same bits, in a decimal that holds 64 of them."""
    wide = c.cast("decimal(20,0)")
    return F.when(c < 0, wide + F.lit(Decimal(1 << (8 * width)))).otherwise(wide)


def facts(rows: DataFrame, column: str, by: str = "stripe_id") -> DataFrame:
    """The statistics of a column that estimates need, by group: nulls take no part."""
    kind = rows.schema[column].dataType
    own = rows.select(by, "row_id", F.col(column).alias("v")).where(F.col("v").isNotNull())
    counted = own.groupBy(by, "v").agg(F.count("*").alias("c"))
    run = stats.run_stats(own, "v", by)
    text = isinstance(kind, T.StringType)
    sums = [F.sum("c").alias("n"), F.count("*").alias("ndv"), F.max("c").alias("mode_n")]
    if text:
        size = F.octet_length("v")
        sums += [F.sum(size * F.col("c")).alias("total"), F.sum(size).alias("uniq_total"), F.min(size).alias("min_len"), F.max(size).alias("max_len")]
        base = counted.groupBy(by).agg(*sums)
        top = counted.join(base.select(by, "mode_n"), by).where("c = mode_n").groupBy(by).agg(F.min("v").alias("mode"))
        rest = counted.join(top, by).where("v <> mode").groupBy(by).agg(F.min(size).alias("rest_min"), F.max(size).alias("rest_max"))
        return base.join(top, by).join(rest, by, "left").join(run, by).withColumn("mode_len", F.octet_length("mode")).drop("mode")
    if isinstance(kind, T.BooleanType):
        return counted.groupBy(by).agg(*sums, F.sum(F.when(F.col("v"), F.col("c")).otherwise(0)).alias("ones")).join(run, by)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        as_long = double_bits("v", isinstance(kind, T.FloatType))
    else:
        as_long = F.unix_micros(F.col("v").cast("timestamp")) if kind.typeName().startswith("timestamp") else F.col("v").cast("long")
    u = counted.withColumn("u", unsigned(as_long, WIDTHS[kind.typeName()]))
    ends = u.groupBy(by).agg(*sums, F.min("u").alias("lo"), F.max("u").alias("hi")).withColumn("span", F.col("hi") - F.col("lo"))
    less = F.col("u") - F.col("lo")
    # Decimals of up to 64 bits to bits: in two halves, each a long.
    high = F.floor(less / F.lit(1 << 32)).cast("long")
    bits = F.when(high > 0, F.length(F.bin(high)) + 32).otherwise(F.length(F.bin(less.cast("long"))))
    size = F.greatest(F.lit(1), F.ceil(bits / 7))
    varint = u.join(ends.select(by, "lo"), by).groupBy(by).agg(F.sum(size * F.col("c")).alias("varint_bytes"))
    return ends.join(varint, by).join(run, by)


def estimable(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.BooleanType)) or kind.typeName() in WIDTHS


def estimates(rows: DataFrame, column: str, by: str = "stripe_id") -> DataFrame:
    """(by, encoding, size, place) of each usable encoding of a column; place: its order of trial."""
    kind = rows.schema[column].dataType
    if isinstance(kind, T.StringType):
        table = string_estimates()
    elif isinstance(kind, T.BooleanType):
        table = bool_estimates()
    else:
        table = numeric_estimates(WIDTHS[kind.typeName()])
    order = list(READ_FACTORS)
    each = [F.struct(F.lit(e).alias("encoding"), c.cast("long").alias("size"), F.lit(order.index(e)).alias("place")) for e, c in table.items()]
    return facts(rows, column, by).select(by, F.explode(F.array(*each)).alias("e")).select(by, "e.*").where(F.col("size").isNotNull())


def choose(sized: DataFrame, by: Sequence[str], factors: dict[str, float] | None = None) -> DataFrame:
    """(by, encoding, size): the least size times factor; ties go to the encoding tried first."""
    factors = factors or READ_FACTORS
    factor = F.create_map(*[x for e, f in factors.items() for x in (F.lit(e), F.lit(f))])
    costed = sized.withColumn("_cost", F.col("size") * F.try_element_at(factor, F.col("encoding"))).where(F.col("_cost").isNotNull())
    return costed.groupBy(*by).agg(F.min(F.struct("_cost", "place", "encoding", "size")).alias("b")).select(*by, "b.encoding", "b.size")


def choose_all(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ("stripe_id",), factors: dict[str, float] | None = None) -> DataFrame:
    """(column, stripe_id, encoding, size) for each column and stripe."""
    parts = [estimates(rows, c).withColumn("column", F.lit(c)) for c in columns]
    return choose(reduce(DataFrame.unionByName, parts), ["column", *by], factors)


def cascade(rows: DataFrame, column: str, depth: int = 2, factors: dict[str, float] | None = None) -> list[tuple[str, str, int]]:
    """(path, encoding, size) of a column's encoding and its nested streams, each level without its parents' encodings.

    One Spark job for each nested stream; the result is a handful of rows, whatever the table.
    """
    factors = dict(factors or READ_FACTORS)
    whole = rows.select(F.lit(0).alias("stripe_id"), "row_id", column)
    out: list[tuple[str, str, int]] = []

    def walk(df: DataFrame, path: str, left: dict[str, float], level: int) -> None:
        best = choose(estimates(df, column), ["stripe_id"], left).first()
        if best is None:
            return
        out.append((path, best["encoding"], best["size"]))
        rest = {e: f for e, f in left.items() if e != best["encoding"]}
        if level < depth and best["encoding"] == "Dictionary":
            ranks = df.select(F.col(column).alias("v")).distinct()
            from laminar.operators.codecs import dictionary_codes

            walk(dictionary_codes(df, ranks, column).select("stripe_id", "row_id", F.col("code").alias(column)), f"{path}/indices", rest, level + 1)
        elif level < depth and best["encoding"] == "RLE":
            found = stats.runs(df, column)
            walk(found.select("stripe_id", F.col("run").alias("row_id"), F.col("length").alias(column)), f"{path}/lengths", rest, level + 1)

    walk(whole, column, factors, 0)
    return out


def accepts_compression(raw, compressed, ratio: float = 0.98) -> Column:
    """Whether compressed bytes are kept: only if they are at most ``ratio`` of the raw ones."""
    return F.coalesce(_n(compressed) <= _n(raw) * ratio, F.lit(False))
