"""Scalar functions of the codecs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def zigzag(x) -> Column:
    """Signed to unsigned, small magnitudes to small values: 0, -1, 1, -2 to 0, 1, 2, 3."""
    v = _c(x).cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(x) -> Column:
    v = _c(x).cast("long")
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-v.bitwiseAND(F.lit(1).cast("long")))


def bits(x) -> Column:
    """Bits that a value of 0 or more needs; 1 for 0."""
    return F.length(F.bin(_c(x).cast("long")))


def bits_or_none(x) -> Column:
    """Bits that a range of values needs; 0 for 0."""
    return F.when(_c(x) == 0, 0).otherwise(bits(x))


def varint_size(x) -> Column:
    """Bytes of seven bits that a value of 0 or more needs."""
    return F.greatest(F.lit(1), F.ceil(bits(x) / 7)).cast("int")


def split_nanos(nanos, wide: bool = False) -> tuple[Column, Column]:
    """Microseconds, rounded down, and the nanoseconds left, 0 to 999.

    wide: nanoseconds as decimals without a fraction, past the 292 years that a long holds; microseconds past the range of
    a long are an error.
    """
    if wide:
        t = _c(nanos).cast("decimal(38,0)")
        rest = F.pmod(t, F.lit(1000)).cast("long")
        return ((t - rest) / F.lit(1000)).cast("long"), rest
    t = _c(nanos).cast("long")
    rest = F.pmod(t, F.lit(1000).cast("long"))
    # Whole-number division, as a double cannot hold present-day nanoseconds; of the rest first, so that nothing overflows.
    return F.call_function("div", t, F.lit(1000).cast("long")) - F.when((t < 0) & (rest > 0), 1).otherwise(0), rest


def same_map(a, b) -> Column:
    """Equality of maps whatever the order of their entries; null is equal to nothing."""
    return F.coalesce(F.array_sort(F.map_entries(_c(a))) == F.array_sort(F.map_entries(_c(b))), F.lit(False))


def decimal_scale(x, exponent: int) -> tuple[Column, Column]:
    """The value times a power of ten, rounded, and whether dividing gives the value back exactly, its sign included."""
    scaled = F.rint(_c(x) * float(10**exponent)).try_cast("long")  # null past the range of a long
    same = (scaled / float(10**exponent) == _c(x)) & ~negative_zero(x)
    return scaled, F.coalesce(same, _c(x).isNull())


def negative_zero(x) -> Column:
    """Whether a double is -0.0, which equals 0.0: only its text tells."""
    return (_c(x) == 0) & _c(x).cast("string").startswith("-")


def double_bits(x, single: bool = False) -> Column:
    """The bits of a double (or, of a float, its 32), as the integer that has the same.

    SQL has no cast for it, so they are put together: a scaling by a power of two is exact, which gives the exponent and
    the mantissa as whole numbers. NaN counts as the quiet one without a payload.
    """
    digits, bias, least = (23, 127, -126) if single else (52, 1023, -1022)
    v = _c(x).cast("double")
    a = F.abs(v)
    two = F.lit(2.0)
    # The scaling goes in two steps, as the power itself would overflow at the ends of the range.
    guess = F.greatest(F.floor(F.log2(a)), F.lit(least)).cast("int")

    def scaled(e: Column) -> Column:
        h = F.floor(e / 2)
        return a * F.pow(two, -h) * F.pow(two, h - e)

    at = F.when(scaled(guess) >= 2, guess + 1).when((scaled(guess) < 1) & (guess > least), guess - 1).otherwise(guess)
    m = scaled(at)
    fraction = F.when(m >= 1, m - 1).otherwise(m) * F.lit(float(1 << digits))
    exponent = F.when(m >= 1, at + bias).otherwise(F.lit(0))
    normal = F.shiftleft(exponent.cast("long"), digits) + F.rint(fraction).cast("long")
    top = F.lit(((1 << (8 if single else 11)) - 1) << digits).cast("long")
    body = F.when(F.isnan(v), top + (1 << (digits - 1))).when(a == float("inf"), top).when(a == 0, F.lit(0).cast("long")).otherwise(normal)
    sign = F.when(~F.isnan(v) & ((v < 0) | negative_zero(v)), F.lit(1 << 31 if single else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.when(v.isNotNull(), sign.bitwiseOR(body))


def pack(rows: DataFrame, width: int, per_word: int) -> DataFrame:
    """Values v at places i packed into words of per_word values of width bits: (word, packed, n)."""
    word = F.floor(F.col("i") / per_word).cast("long").alias("word")
    shifted = F.expr(f"shiftleft(cast(v AS bigint), cast((i % {per_word}) * {width} AS int))")
    return rows.withColumn("_s", shifted).groupBy(word).agg(F.sum("_s").alias("packed"), F.count("*").alias("n"))


def unpack(words: DataFrame, width: int, per_word: int) -> DataFrame:
    """(i, v) of packed words; places past the last value read as 0."""
    i = F.explode(F.sequence(F.lit(0), F.lit(per_word - 1)))
    out = words.withColumn("_j", i)
    value = F.expr(f"shiftrightunsigned(packed, _j * {width}) & {(1 << width) - 1}L")
    return out.select((F.col("word") * per_word + F.col("_j")).alias("i"), value.alias("v"))
