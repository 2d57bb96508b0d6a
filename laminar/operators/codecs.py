"""Encodings as tables of encoded values, and back: what each codec stores, without its bytes.

Columns come as rows (stripe_id, row_id, v); each group is encoded on its own. Every pair of functions is an exact round
trip, nulls and the sign of zero included, for the columns that it takes: packed integers (``fixed_width``, ``blocks``,
``patched``, ``varints``, ``delta_blocks``) are of columns without nulls whose rows follow each other within a group, as a
laid-out table's do; nulls are cut off before by ``nullable``. Sequences that need the order of a whole column are cut at
stripes, so windows hold a stripe each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from laminar.operators import stats

GROUP = "stripe_id"


def column(df: DataFrame, name: str) -> DataFrame:
    return df.select(GROUP, "row_id", F.col(name).alias("v"))


# Runs.


def rle(rows: DataFrame) -> DataFrame:
    return stats.runs(rows, "v", GROUP)


def rle_decode(runs: DataFrame) -> DataFrame:
    order = Window.partitionBy(GROUP).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("first_row") if "first_row" in runs.columns else F.coalesce(F.sum("length").over(order), F.lit(0))
    return runs.select(GROUP, "v", F.explode(F.sequence(place, place + F.col("length") - 1)).alias("row_id")).select(GROUP, "row_id", "v")


# Dictionaries.


def alphabet(rows: DataFrame, by_group: bool = True) -> DataFrame:
    """(group, code, v): distinct values in order, numbered; of the whole column if not by group.

    A shared alphabet is numbered from range-partitioned counts, as row numbers are.
    """
    if by_group:
        values = rows.select(GROUP, "v").distinct()
        return values.withColumn("code", (F.row_number().over(Window.partitionBy(GROUP).orderBy("v")) - 1).cast("long"))
    from laminar.table import ColTable

    laid = ColTable.lay_out(rows.select("v").distinct(), ["v"])
    return laid.df.select(F.col("row_id").alias("code"), "v")


def dictionary(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alphabet, codes) of each group; a null has no letter and a null code."""
    letters = alphabet(rows.where(F.col("v").isNotNull()))
    return letters, rows.join(letters, [GROUP, "v"], "left").select(GROUP, "row_id", "code")


def dictionary_decode(letters: DataFrame, codes: DataFrame) -> DataFrame:
    on = [c for c in (GROUP, "code") if c in letters.columns]
    return codes.join(letters, on, "left").select(GROUP, "row_id", "v")


def dictionary_codes(df: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """df's rows with the code of their value among the distinct ``values`` (v)."""
    from laminar.table import ColTable

    laid = ColTable.lay_out(values, ["v"]).df.select(F.col("v").alias(name), F.col("row_id").alias("code"))
    return df.join(laid, name)


# Nulls and single values.


def nullable(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nulls, values): which rows are null, and the others' values at dense places."""
    order = Window.partitionBy(GROUP).orderBy("row_id")
    marks = rows.select(GROUP, "row_id", F.col("v").isNull().alias("is_null"))
    dense = rows.where(F.col("v").isNotNull()).withColumn("place", F.row_number().over(order) - 1)
    return marks, dense.select(GROUP, "place", "v")


def nullable_decode(marks: DataFrame, values: DataFrame) -> DataFrame:
    order = Window.partitionBy(GROUP).orderBy("row_id")
    place = F.sum(F.when(F.col("is_null"), 0).otherwise(1)).over(order) - 1
    at = marks.withColumn("place", F.when(~F.col("is_null"), place))
    return at.join(values, [GROUP, "place"], "left").select(GROUP, "row_id", "v")


def sentinel(rows: DataFrame) -> DataFrame:
    """(group, row_id, v, sentinel): null integers as one more than the group's largest value."""
    above = F.coalesce(F.max("v").over(Window.partitionBy(GROUP)) + 1, F.lit(0)).cast("long")
    return rows.withColumn("sentinel", above).withColumn("v", F.coalesce(F.col("v").cast("long"), F.col("sentinel")))


def sentinel_decode(rows: DataFrame) -> DataFrame:
    return rows.select(GROUP, "row_id", F.when(F.col("v") != F.col("sentinel"), F.col("v")).alias("v"))


def sparse_bool(rows: DataFrame) -> DataFrame:
    """(group, row_id, rare): the rows of the rarer value of each group, false on ties."""
    count = Window.partitionBy(GROUP)
    ones = F.sum(F.col("v").cast("int")).over(count)
    rare = ones * 2 < F.count("*").over(count)
    return rows.withColumn("rare", rare).where(F.col("v") == F.col("rare")).select(GROUP, "row_id", "rare")


def sparse_bool_head(rows: DataFrame) -> DataFrame:
    """(group, first_row, n, rare): what a group stores beside its marks."""
    return rows.groupBy(GROUP).agg(F.min("row_id").alias("first_row"), F.count("*").alias("n"), (F.sum(F.col("v").cast("int")) * 2 < F.count("*")).alias("rare"))


def sparse_bool_decode(head: DataFrame, marks: DataFrame) -> DataFrame:
    at = F.explode(F.sequence("first_row", F.col("first_row") + F.col("n") - 1)).alias("row_id")
    whole = head.select(GROUP, "rare", at).join(marks.select(GROUP, "row_id", F.lit(True).alias("_m")), [GROUP, "row_id"], "left")
    return whole.select(GROUP, "row_id", F.when(F.col("_m"), F.col("rare")).otherwise(~F.col("rare")).alias("v"))


def mainly_constant(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(common, others): each group's most frequent value, and the rows that differ from it."""
    common = stats.most_frequent(rows, "v", [GROUP]).select(GROUP, F.col("v").alias("common"), "n")
    return common, rows.join(common, GROUP).where(~F.col("v").eqNullSafe(F.col("common"))).select(GROUP, "row_id", "v")


def mainly_constant_decode(common: DataFrame, others: DataFrame, rows: DataFrame) -> DataFrame:
    """rows: (group, row_id) of all rows."""
    marked = others.select(GROUP, "row_id", F.col("v").alias("_o"), F.lit(True).alias("_other"))
    whole = rows.select(GROUP, "row_id").join(common, GROUP).join(marked, [GROUP, "row_id"], "left")
    return whole.select(GROUP, "row_id", F.when(F.col("_other"), F.col("_o")).otherwise(F.col("common")).alias("v"))


# Differences and frames.


def delta(rows: DataFrame) -> DataFrame:
    """(group, row_id, restated, value): the difference from the row before; a first row or a decrease is restated."""
    before = F.lag("v").over(Window.partitionBy(GROUP).orderBy("row_id"))
    restated = before.isNull() | (F.col("v") < before)
    marked = rows.withColumn("_p", before).withColumn("restated", restated)
    return marked.select(GROUP, "row_id", "restated", F.when(F.col("restated"), F.col("v")).otherwise(F.col("v") - F.col("_p")).alias("value"))


def delta_decode(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy(GROUP).orderBy("row_id")
    grouped = rows.withColumn("_g", F.sum(F.col("restated").cast("int")).over(order))
    return grouped.select(GROUP, "row_id", F.sum("value").over(Window.partitionBy(GROUP, "_g").orderBy("row_id")).alias("v"))


def frames(rows: DataFrame, size: int) -> DataFrame:
    """(frame, row_id, base, offset): values less the least of their frame of ``size`` rows."""
    frame = F.floor(F.col("row_id") / size).cast("long")
    framed = rows.withColumn("frame", frame)
    return framed.withColumn("base", F.min("v").over(Window.partitionBy("frame"))).select(GROUP, "frame", "row_id", "base", (F.col("v") - F.col("base")).alias("offset"))


def frames_decode(rows: DataFrame) -> DataFrame:
    return rows.select(GROUP, "row_id", (F.col("base") + F.col("offset")).alias("v"))


def frame_table(rows: DataFrame, size: int) -> DataFrame:
    """(frame, base, width, count): what each frame stores before its offsets; width 0 where all values are equal."""
    frame = F.floor(F.col("row_id") / size).cast("long").alias("frame")
    span = (F.max("v") - F.min("v")).cast("long")
    width = F.when(span == 0, 0).otherwise(F.length(F.bin(span)))
    return rows.groupBy(frame).agg(F.min("v").alias("base"), width.cast("long").alias("width"), F.count("*").alias("count"))


# Packed integers: groups of offsets from a base, as 32-bit words.

WORD = 32


def _words(values: str, width: str) -> str:
    """The words of an array of values of that many bits, the first value lowest."""
    part = f"if(i * {width} >= j * {WORD}, shiftleft(get({values}, i), i * {width} - j * {WORD}), shiftrightunsigned(get({values}, i), j * {WORD} - i * {width}))"
    over = f"sequence(cast(floor(j * {WORD} / {width}) AS int), least(size({values}) - 1, cast(floor((j * {WORD} + {WORD - 1}) / {width}) AS int)))"
    word = f"aggregate({over}, 0L, (a, i) -> a | ({part} & {(1 << WORD) - 1}L))"
    return f"if({width} = 0, array(), transform(sequence(0, cast(ceil(size({values}) * {width} / {WORD}) AS int) - 1), j -> {word}))"


def _value(words: str, width: str, i: str) -> str:
    """The value at place i of packed words: only the words that hold it are looked at."""
    low, high = f"cast(floor(({i}) * {width} / {WORD}) AS int)", f"cast(floor((({i}) * {width} + {width} - 1) / {WORD}) AS int)"
    part = f"if(j * {WORD} >= ({i}) * {width}, shiftleft(get({words}, j), j * {WORD} - ({i}) * {width}), shiftrightunsigned(get({words}, j), ({i}) * {width} - j * {WORD}))"
    mask = f"shiftrightunsigned(-1L, 64 - {width})"
    return f"if({width} = 0, 0L, aggregate(sequence({low}, {high}), 0L, (a, j) -> a | {part}) & {mask})"


def _width(span) -> Column:
    """Bits of a span of values, 0 for none."""
    return F.when(span == 0, 0).otherwise(F.length(F.bin(span.cast("long")))).cast("int")


def _placed(rows: DataFrame, size: int) -> DataFrame:
    """rows with ``place`` in their group, and ``frame``: ``size`` successive rows of it."""
    start = rows.groupBy(GROUP).agg(F.min("row_id").alias("_start"))
    placed = rows.join(start, GROUP).withColumn("place", (F.col("row_id") - F.col("_start")).cast("int"))
    return placed.withColumn("frame", F.floor(F.col("place") / size).cast("int")).withColumn("v", F.col("v").cast("long")).drop("_start")


def _packed(placed: DataFrame, by: list[str]) -> DataFrame:
    """(by, frame, first_row, base, width, n, words) of rows with place, frame, base and width."""
    grouped = placed.groupBy(*by, "frame", "base", "width").agg(F.min("row_id").alias("first_row"), F.count("*").cast("int").alias("n"), F.sort_array(F.collect_list(F.struct("place", (F.col("v") - F.col("base")).alias("o")))).alias("_v"))
    return grouped.withColumn("_o", F.col("_v.o")).select(*by, "frame", "first_row", "base", "width", "n", F.expr(_words("_o", "width")).alias("words"))


def fixed_width(rows: DataFrame, size: int = 1024) -> DataFrame:
    """(group, frame, first_row, base, width, n, words): offsets from the group's least value, all of the width of its span.

    Base and width are the group's; frames of ``size`` rows only say which words lie together.
    """
    span = rows.groupBy(GROUP).agg(F.min("v").cast("long").alias("base"), _width(F.max("v") - F.min("v")).alias("width"))
    return _packed(_placed(rows, size).join(span, GROUP), [GROUP])


def blocks(rows: DataFrame, size: int = 1024) -> DataFrame:
    """As ``fixed_width``, with a base and a width for each frame."""
    placed, by = _placed(rows, size), Window.partitionBy(GROUP, "frame")
    based = placed.withColumn("base", F.min("v").over(by)).withColumn("width", _width(F.max("v").over(by) - F.col("base")))
    return _packed(based, [GROUP])


def unpacked(packed: DataFrame) -> DataFrame:
    """(group, row_id, v) of packed frames."""
    one = packed.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return one.select(GROUP, (F.col("first_row") + F.col("_i")).alias("row_id"), (F.col("base") + F.expr(_value("words", "width", "_i"))).alias("v"))


def value_at(packed: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(row_id, v) of the wanted row numbers, taken out of their frames' words alone. Groups begin at whole frames."""
    near = wanted.select("row_id", F.floor(F.col("row_id") / size).alias("_f"))
    held = packed.withColumn("_f", F.floor(F.col("first_row") / size))
    met = near.join(held, "_f").withColumn("_i", (F.col("row_id") - F.col("first_row")).cast("int")).where((F.col("_i") >= 0) & (F.col("_i") < F.col("n")))
    return met.select("row_id", (F.col("base") + F.expr(_value("words", "width", "_i"))).alias("v"))


def slice_of(packed: DataFrame, start: int, end: int) -> DataFrame:
    """(group, row_id, v) of row numbers from start to end - 1: frames outside are dropped, and values outside not unpacked."""
    met = packed.where((F.col("first_row") < end) & (F.col("first_row") + F.col("n") > start))
    low, high = F.greatest(F.lit(0), F.lit(start) - F.col("first_row")), F.least(F.col("n").cast("long"), F.lit(end) - F.col("first_row")) - 1
    one = met.withColumn("_i", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    return one.select(GROUP, (F.col("first_row") + F.col("_i")).alias("row_id"), (F.col("base") + F.expr(_value("words", "width", "_i"))).alias("v"))


def block_packed_bytes(rows: DataFrame, size: int, width: int) -> DataFrame:
    """(frame, bytes): packed with seven spare bytes, or raw where that is less."""
    t = frame_table(rows, size)
    return t.select("frame", F.least(F.ceil(F.col("count") * F.col("width") / 8) + 7, F.col("count") * width).cast("long").alias("bytes"))


def patched(rows: DataFrame, share: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(base, exceptions) of each group: the least number of seven-bit groups that holds ``share`` of values less the
    minimum, and the rows that need more."""
    from laminar.sources.shared import materialize

    # Written, so that the optimizer knows that it is small, a row a group, and need not shuffle the rows to meet it.
    base = materialize(rows.groupBy(GROUP).agg(F.min("v").alias("base"), F.count("*").alias("n")), "base")
    sized = rows.join(base, GROUP).withColumn("bits", F.length(F.bin((F.col("v") - F.col("base")).cast("long"))))
    groups = sized.withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("bits") / 7)).cast("int"))
    counts = groups.groupBy(GROUP, "n", "base", "k").agg(F.count("*").alias("c"))
    reached = F.sum("c").over(Window.partitionBy(GROUP).orderBy("k"))
    width = counts.withColumn("_r", reached).where(F.col("_r") >= F.col("n") * share).groupBy(GROUP, "base", "n").agg((F.min("k") * 7).alias("width"))
    outside = groups.select(GROUP, "row_id", "v", "bits").join(width.select(GROUP, "width"), GROUP).where(F.col("bits") > F.col("width"))
    return width, outside.select(GROUP, "row_id", "v")


def patched_packed(rows: DataFrame, size: int = 1024, share: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(frames, exceptions): packed offsets of the width that ``share`` of the values need, zeros for the others."""
    width, outside = patched(rows, share)
    fits = F.length(F.bin(F.col("v") - F.col("base"))) <= F.col("width")
    inside = _placed(rows, size).join(width.select(GROUP, F.col("base").cast("long").alias("base"), F.least("width", F.lit(63)).alias("width")), GROUP)
    return _packed(inside.withColumn("v", F.when(fits, F.col("v")).otherwise(F.col("base"))), [GROUP]), outside


def patched_decode(packed: DataFrame, outside: DataFrame) -> DataFrame:
    patch = outside.select(GROUP, "row_id", F.col("v").cast("long").alias("_x"))
    return unpacked(packed).join(patch, [GROUP, "row_id"], "left").select(GROUP, "row_id", F.coalesce("_x", "v").alias("v"))


def varints(rows: DataFrame, size: int = 1024) -> DataFrame:
    """(group, frame, first_row, base, n, bytes): offsets from the group's least value, seven bits to a byte, lowest first;
    the high bit says that more follow."""
    base = rows.groupBy(GROUP).agg(F.min("v").cast("long").alias("base"))
    placed = _placed(rows, size).join(base, GROUP).withColumn("_o", F.col("v") - F.col("base"))
    each = "transform(sequence(0, cast(greatest(1, ceil(length(bin(_o)) / 7)) AS int) - 1), i -> cast((shiftrightunsigned(_o, 7 * i) & 127) | if(shiftrightunsigned(shiftrightunsigned(_o, 7 * i), 7) = 0, 0, 128) AS int))"
    coded = placed.withColumn("_b", F.expr(each))
    grouped = coded.groupBy(GROUP, "frame", "base").agg(F.min("row_id").alias("first_row"), F.count("*").cast("int").alias("n"), F.sort_array(F.collect_list(F.struct("place", "_b"))).alias("_all"))
    return grouped.select(GROUP, "frame", "first_row", "base", "n", F.flatten("_all._b").alias("bytes"))


def varints_decode(coded: DataFrame) -> DataFrame:
    """A value ends at each byte below 128; its bytes are those after the end before."""
    ends = coded.withColumn("_ends", F.expr("filter(transform(bytes, (b, i) -> if(b < 128, i, -1)), i -> i >= 0)"))
    one = ends.select("*", F.posexplode("_ends").alias("_i", "_end")).withColumn("_from", F.expr("coalesce(get(_ends, _i - 1) + 1, 0)"))
    value = F.expr("aggregate(sequence(_from, _end), 0L, (a, i) -> a | shiftleft(cast(get(bytes, i) & 127 AS bigint), 7 * (i - _from)))")
    return one.select(GROUP, (F.col("first_row") + F.col("_i")).alias("row_id"), (F.col("base") + value).alias("v"))


def delta_blocks(rows: DataFrame, size: int) -> DataFrame:
    """(frame, base, max_delta, sorted): checkpoints of blocks; one that decreases inside cannot be encoded so."""
    frame = F.floor(F.col("row_id") / size).cast("long")
    stepped = rows.withColumn("frame", frame)
    step = F.col("v") - F.lag("v").over(Window.partitionBy("frame").orderBy("row_id"))
    return stepped.withColumn("d", step).groupBy("frame").agg(F.min_by("v", "row_id").alias("base"), F.coalesce(F.max("d"), F.lit(0)).alias("max_delta"), F.coalesce(F.min("d") >= 0, F.lit(True)).alias("sorted"))


def delta_blocks_packed(rows: DataFrame, size: int) -> DataFrame:
    """(group, frame, first_row, checkpoint, base, width, n, words): differences within blocks, packed, and their first value.

    For columns that do not decrease within a block; the first difference of a block is 0.
    """
    placed, by = _placed(rows, size), Window.partitionBy(GROUP, "frame")
    step = F.coalesce(F.col("v") - F.lag("v").over(by.orderBy("place")), F.lit(0))
    stepped = placed.withColumn("_first", F.first("v").over(by.orderBy("place"))).withColumn("v", step)
    kept = stepped.withColumn("base", F.lit(0).cast("long")).withColumn("width", _width(F.max("v").over(by)))
    fine = kept.withColumn("v", F.when(F.col("v") >= 0, F.col("v")).otherwise(F.raise_error(F.lit("a block decreases"))))
    return _packed(fine.withColumnRenamed("_first", "checkpoint"), [GROUP, "checkpoint"])


def delta_blocks_decode(coded: DataFrame) -> DataFrame:
    steps = coded.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    steps = steps.select(GROUP, "frame", "checkpoint", (F.col("first_row") + F.col("_i")).alias("row_id"), F.expr(_value("words", "width", "_i")).alias("d"))
    sums = F.sum("d").over(Window.partitionBy(GROUP, "frame").orderBy("row_id"))
    return steps.select(GROUP, "row_id", (F.col("checkpoint") + sums).alias("v"))


def bit_ranges(rows: DataFrame, cuts: list[int]) -> DataFrame:
    """Values of 0 or more split at bit positions: a column part0, part1, ... for each range of bits, lowest first."""
    ends = [*cuts[1:], 63]
    parts = [F.expr(f"shiftrightunsigned(v, {a}) & {(1 << (b - a)) - 1}L").alias(f"part{i}") for i, (a, b) in enumerate(zip(cuts, ends, strict=True))]
    return rows.withColumn("v", F.col("v").cast("long")).select(GROUP, "row_id", *parts)


def bit_ranges_decode(rows: DataFrame, cuts: list[int]) -> DataFrame:
    value = sum((F.shiftleft(F.col(f"part{i}"), a) for i, a in enumerate(cuts)), F.lit(0).cast("long"))
    return rows.select(GROUP, "row_id", value.alias("v"))


def frequency_tiers(rows: DataFrame, tiers: list[int]) -> DataFrame:
    """(v, n, place, tier): values by frequency, and the tier of code lengths each falls in.

    tiers: how many values each tier but the last holds. The order is over distinct values, numbered by ranges.
    """
    from laminar.operators.scan import composite_order

    counts = stats.unique_counts(rows, "v")
    placed = composite_order(counts, [("n", False), ("v", True)])
    tier, edge = F.lit(len(tiers)), 0
    for i, size in reversed(list(enumerate(tiers))):
        edge = sum(tiers[: i + 1])
        tier = F.when(F.col("place") < edge, i).otherwise(tier)
    return placed.withColumn("tier", tier)


def frequency_codes(rows: DataFrame, tiers: list[int]) -> tuple[DataFrame, DataFrame]:
    """(values, codes): values by tier and place in it, and each row's tier and place."""
    placed = frequency_tiers(rows.select("v"), tiers)
    edges = F.create_map(*[F.lit(x) for i in range(len(tiers) + 1) for x in (i, sum(tiers[:i]))])
    values = placed.select("tier", (F.col("place") - edges[F.col("tier")]).alias("code"), "v")
    return values, rows.join(values, "v").select(GROUP, "row_id", "tier", "code")


def frequency_decode(values: DataFrame, codes: DataFrame) -> DataFrame:
    return codes.join(values, ["tier", "code"]).select(GROUP, "row_id", "v")


def alp_exponent(rows: DataFrame, most: int = 18) -> int:
    """The power of ten that stores a column's doubles in the fewest bits: exceptions take 64, the others the largest's."""
    from laminar.functions.scalar import decimal_scale

    facts = []
    for e in range(most + 1):
        scaled, exact = decimal_scale("v", e)
        facts += [F.count_if(exact).alias(f"n{e}"), F.max(F.when(exact, F.abs(scaled))).alias(f"m{e}")]
    found = rows.where(F.col("v").isNotNull()).agg(F.count("*").alias("n"), *facts).first()
    cost = [found[f"n{e}"] * (int(found[f"m{e}"] or 0).bit_length() + 1) + (found["n"] - found[f"n{e}"]) * 64 for e in range(most + 1)]
    return min(range(most + 1), key=lambda e: (cost[e], e))


def alp(rows: DataFrame, exponent: int) -> DataFrame:
    """(group, row_id, scaled, exception): doubles as integers times a power of ten, where that is exact."""
    from laminar.functions.scalar import decimal_scale

    scaled, exact = decimal_scale("v", exponent)
    return rows.select(GROUP, "row_id", F.when(exact, scaled).alias("scaled"), F.when(~exact, F.col("v")).alias("exception"))


def alp_decode(rows: DataFrame, exponent: int) -> DataFrame:
    return rows.select(GROUP, "row_id", F.coalesce("exception", F.col("scaled") / float(10**exponent)).alias("v"))


def shared_prefix(rows: DataFrame, restart: int = 16) -> DataFrame:
    """(group, row_id, shared, suffix): strings less what they share with the one before; whole at restart points."""
    order = Window.partitionBy(GROUP).orderBy("row_id")
    before = F.when(F.col("row_id") % restart != 0, F.lag("v").over(order))
    pair = rows.withColumn("_b", F.coalesce(before, F.lit("")))
    # The longest shared prefix, by halving: the prefix of a length that is shared is shared at all lengths below.
    step = "if(left(v, s + p) = left(_b, s + p) AND s + p <= least(length(v), length(_b)), s + p, s)"
    same = f"aggregate(transform(sequence(0, 30), i -> shiftleft(1, 30 - i)), 0, (s, p) -> {step})"
    return pair.withColumn("shared", F.expr(same)).select(GROUP, "row_id", F.col("shared").cast("long").alias("shared"), F.expr("substring(v, shared + 1)").alias("suffix"))


def shared_prefix_decode(coded: DataFrame, restart: int = 16) -> DataFrame:
    """Strings from what they share with the one before, block by block between restart points."""
    block = F.floor(F.col("row_id") / restart).alias("_b")
    grouped = coded.groupBy(GROUP, block).agg(F.sort_array(F.collect_list(F.struct("row_id", "shared", "suffix"))).alias("s"))
    return grouped.select(GROUP, F.explode(F.expr(_UNFOLD)).alias("x")).select(GROUP, "x.row_id", "x.v")


_UNFOLD = (
    "aggregate(s, named_struct('last', '', 'out', cast(array() AS array<struct<row_id: bigint, v: string>>)), "
    "(a, x) -> named_struct('last', left(a.last, cast(x.shared AS int)) || x.suffix, "
    "'out', array_append(a.out, named_struct('row_id', x.row_id, 'v', left(a.last, cast(x.shared AS int)) || x.suffix))), a -> a.out)"
)


def prefix_seek(coded: DataFrame, target: str, restart: int = 16) -> DataFrame:
    """(group, row_id): in each group of a sorted column the first row whose string is not below the target, if any.

    Heads at restart points stand whole, so only the last block whose head is below the target, and the next, are decoded.
    """
    heads = coded.where(F.col("row_id") % restart == 0).select(GROUP, "row_id", F.col("suffix").alias("head"))
    below = heads.where(F.col("head") < target).groupBy(GROUP).agg(F.max("row_id").alias("_from"))
    first = coded.groupBy(GROUP).agg(F.min("row_id").alias("_least"))
    start = first.join(below, GROUP, "left").select(GROUP, F.coalesce("_from", "_least").alias("_from"))
    block = F.floor(F.col("row_id") / restart)
    near = coded.join(start, GROUP).where((block >= F.floor(F.col("_from") / restart)) & (block <= F.floor(F.col("_from") / restart) + 1))
    return shared_prefix_decode(near.drop("_from"), restart).where(F.col("v") >= target).groupBy(GROUP).agg(F.min("row_id").alias("row_id"))


def huffman_lengths(counts: list[tuple[object, int]]) -> dict[object, int]:
    """Canonical code lengths of values by count; for an alphabet of at most a few thousand values."""
    import heapq

    if len(counts) == 1:
        return {counts[0][0]: 1}
    heap = [(n, i, (v,)) for i, (v, n) in enumerate(sorted(counts, key=lambda x: (x[1], str(x[0]))))]
    heapq.heapify(heap)
    depth = {v: 0 for v, _ in counts}
    tick = len(heap)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for v in (*x, *y):
            depth[v] += 1
        heapq.heappush(heap, (a + b, tick, (*x, *y)))
        tick += 1
    return depth


#: Values up to which an alphabet is held by the driver and each task.
HUFFMAN_VALUES = 4096
#: Bits that a code of such an alphabet may have.
LONGEST = 12


def limited(depth: dict[object, int], counts: dict[object, int], longest: int = LONGEST) -> dict[object, int]:
    """Code lengths of at most ``longest`` bits: too long ones are cut, and the shares that this takes are given up by the
    rarest values with shorter codes."""
    if len(depth) > 1 << longest:
        raise ValueError(f"{len(depth)} values need codes of more than {longest} bits")
    out = {v: min(n, longest) for v, n in depth.items()}
    over = sum(1 << (longest - n) for n in out.values()) - (1 << longest)
    for v in sorted(out, key=lambda v: (counts[v], str(v))):
        while over > 0 and out[v] < longest:
            over -= 1 << (longest - out[v] - 1)
            out[v] += 1
    for v in sorted(out, key=lambda v: (-counts[v], str(v))):  # room left over goes back to the most frequent
        while out[v] > 1 and over + (1 << (longest - out[v])) <= 0:
            over += 1 << (longest - out[v])
            out[v] -= 1
    return out


def canonical(lengths: dict[object, int]) -> dict[object, str]:
    """Canonical codes, as bits: by length, then value."""
    out, code, last = {}, 0, 0
    for v in sorted(lengths, key=lambda v: (lengths[v], v)):
        code <<= lengths[v] - last
        out[v], last = format(code, f"0{lengths[v]}b"), lengths[v]
        code += 1
    return out


def huffman_length_counts(histogram: dict[int, int]) -> dict[int, int]:
    """How many values have codes of each length, from how many values have each count.

    Nodes of one weight are joined in pairs all at once, so the work grows with the distinct counts, not with the values.
    """
    import heapq

    if sum(histogram.values()) == 1:
        return {1: 1}
    heap = [(n, i, m) for i, (n, m) in enumerate(sorted(histogram.items()))]
    children: list = [None] * len(heap)  # of each kind of node: the kinds of its two parts, or None for a value
    heapq.heapify(heap)

    def join(weight: int, m: int, a: int, b: int) -> None:
        heapq.heappush(heap, (weight, len(children), m))
        children.append((a, b))

    while len(heap) > 1 or heap[0][2] > 1:
        weight, kind, m = heapq.heappop(heap)
        if m > 1:
            join(2 * weight, m // 2, kind, kind)
        if m % 2:
            other, second, left = heapq.heappop(heap)
            if left > 1:
                heapq.heappush(heap, (other, second, left - 1))
            join(weight + other, 1, kind, second)
    depths: list[dict[int, int]] = [{} for _ in children]
    depths[-1] = {0: 1}
    for kind in range(len(children) - 1, len(histogram) - 1, -1):
        for part in children[kind]:
            for depth, m in depths[kind].items():
                depths[part][depth + 1] = depths[part].get(depth + 1, 0) + m
    out: dict[int, int] = {}
    for own in depths[: len(histogram)]:
        for depth, m in own.items():
            out[depth] = out.get(depth, 0) + m
    return dict(sorted(out.items()))


def _first_codes(counts: dict[int, int]) -> dict[int, int]:
    """The least canonical code of each length, from how many codes have it."""
    out, code, last = {}, 0, 0
    for length, m in sorted(counts.items()):
        code <<= length - last
        out[length], code, last = code, code + m, length
    return out


def huffman(rows: DataFrame) -> DataFrame:
    """(v, n, code_length, code) of a column.

    The codes of at most HUFFMAN_VALUES values have at most LONGEST bits. Those of more values are as long as their counts
    make them, which is less than one and a half times the bits of the number of rows; they are numbered by ranges in the
    order of counts, so no task and not the driver holds all values.
    """
    counts = stats.unique_counts(rows, "v").orderBy("v").limit(HUFFMAN_VALUES + 1).collect()
    if len(counts) > HUFFMAN_VALUES:
        return _huffman_many(rows)
    n = {r["v"]: r["n"] for r in counts}
    depth = limited(huffman_lengths(list(n.items())), n)
    code = canonical(depth)
    kind = rows.schema["v"].dataType.simpleString()
    return rows.sparkSession.createDataFrame([(v, n[v], depth[v], code[v]) for v in n], f"v {kind}, n long, code_length long, code string")


def _huffman_many(rows: DataFrame) -> DataFrame:
    """A frequent value has no longer code than a rarer one, so a place in the order of counts tells length and code."""
    from laminar.operators.scan import composite_order
    from laminar.sources.shared import materialize

    counts = materialize(stats.unique_counts(rows, "v"), "counts")
    # Distinct counts: as many as the root of twice the rows at most.
    held = huffman_length_counts({r["n"]: r["count"] for r in counts.groupBy("n").count().collect()})
    first = _first_codes(held)
    end = 0
    length = code = None
    for bits, m in held.items():
        end += m
        own = F.col("place") < end
        at = F.col("place") + F.lit(first[bits] - (end - m))
        length = F.when(own, bits) if length is None else length.when(own, bits)
        code = F.when(own, at) if code is None else code.when(own, at)
    placed = composite_order(counts, [("n", False), ("v", True)]).select("v", "n", length.cast("long").alias("code_length"), code.alias("_c"))
    return materialize(placed.select("v", "n", "code_length", F.expr("lpad(bin(_c), cast(code_length AS int), '0')").alias("code")), "codes")


def _few(codes: DataFrame) -> bool:
    return codes.limit(HUFFMAN_VALUES + 1).count() <= HUFFMAN_VALUES


def huffman_encode(rows: DataFrame, codes: DataFrame, size: int = 1024) -> DataFrame:
    """(group, frame, first_row, n, bits): the codes of ``size`` successive rows, one after another."""
    own = codes.select("v", "code")
    coded = rows.join(F.broadcast(own) if _few(codes) else own, "v")  # at most HUFFMAN_VALUES rows are sent
    framed = coded.withColumn("frame", F.floor(F.col("row_id") / size).cast("long"))
    grouped = framed.groupBy(GROUP, "frame").agg(F.min("row_id").alias("first_row"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("row_id", "code"))).alias("c"))
    return grouped.select(GROUP, "frame", "first_row", "n", F.concat_ws("", "c.code").alias("bits"))


def huffman_decode(coded: DataFrame, codes: DataFrame) -> DataFrame:
    """Reads each frame's bits code by code, by a table of all strings of LONGEST bits; codes of many values by their
    lengths, and then joined with their values."""
    if not _few(codes):
        return _decode_many(coded, codes)
    held = codes.select("v", "code").collect()  # at most HUFFMAN_VALUES rows
    kind, to = codes.schema["v"].dataType.simpleString(), to_arrow_type(codes.schema["v"].dataType)
    longest = max((len(r["code"]) for r in held), default=1)
    table: list = [None] * (1 << longest)
    for r in held:
        first = int(r["code"].ljust(longest, "0"), 2)
        table[first : first + (1 << (longest - len(r["code"])))] = [(r["v"], len(r["code"]))] * (1 << (longest - len(r["code"])))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for group, first, n, bits in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                at, values, padded = 0, [], bits + "0" * longest
                for _ in range(n):
                    v, used = table[int(padded[at : at + longest], 2)]
                    values.append(v)
                    at += used
                yield pa.RecordBatch.from_arrays([pa.array([group] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(values, to)], [GROUP, "row_id", "v"])

    return coded.select(GROUP, "first_row", "n", "bits").mapInArrow(run, f"{GROUP} long, row_id long, v {kind}")


def _decode_many(coded: DataFrame, codes: DataFrame) -> DataFrame:
    """Canonical codes of a length follow each other after all shorter ones, so the next bits tell the length by their size.

    A code travels as the number that its bits make after a 1.
    """
    lengths = [(r["l"], int(r["first"], 2), r["m"]) for r in codes.groupBy(F.length("code").alias("l")).agg(F.min("code").alias("first"), F.count("*").alias("m")).orderBy("l").collect()]
    longest = lengths[-1][0]
    ends = [(first + m) << (longest - bits) for bits, first, m in lengths]
    sizes = [bits for bits, _, _ in lengths]

    def run(batches):
        from bisect import bisect_right

        import pyarrow as pa

        for batch in batches:
            for group, first, n, bits in zip(*(batch.column(i) for i in range(4)), strict=True):
                group, first, n, bits = group.as_py(), first.as_py(), n.as_py(), bits.as_py()
                at, marks, padded = 0, [], bits + "0" * longest
                for _ in range(n):
                    ahead = int(padded[at : at + longest], 2)
                    used = sizes[bisect_right(ends, ahead)]
                    marks.append(1 << used | ahead >> (longest - used))
                    at += used
                yield pa.RecordBatch.from_arrays([pa.array([group] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(marks, pa.int64())], [GROUP, "row_id", "_mark"])

    read = coded.select(GROUP, "first_row", "n", "bits").mapInArrow(run, f"{GROUP} long, row_id long, _mark long")
    values = codes.select(F.conv(F.concat(F.lit("1"), "code"), 2, 10).cast("long").alias("_mark"), "v")
    return read.join(values, "_mark").select(GROUP, "row_id", "v")
