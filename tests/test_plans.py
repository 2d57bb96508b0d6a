"""What plans look like: equality joins for ranges, bounds that reach the reader, and no window over a whole table."""

import datetime
import math
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from laminar.functions import scalar
from laminar.operators import codecs, filters, lookup, scan
from laminar.plans import scan_queries
from laminar.sources import writer
from laminar.table import ColTable


@pytest.fixture(scope="module")
def laid(spark):
    rows = spark.range(4000).select((F.col("id") * 3).alias("k"), (F.col("id") % 50).alias("g"), F.lit("x").alias("s"))
    return ColTable.lay_out(rows, ["k"], stripe_rows=1000, chunk_rows=100)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_lookup_plan(spark, laid):
    asked = spark.createDataFrame([(i, i * 100, i * 100 + 40) for i in range(40)], "request_id int, lo long, hi long")
    df = lookup.range_rows(laid, asked, "k", ["g"])
    text = plan(df)
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert "GreaterThanOrEqual(k,0)" in text and "LessThanOrEqual(k,3940)" in text
    want = sorted((i, k // 3) for i in range(40) for k in range(0, 12000, 3) if i * 100 <= k < i * 100 + 40)
    assert sorted((r["request_id"], r["row_id"]) for r in df.collect()) == want
    assert "NestedLoop" not in plan(lookup.pruned(laid, asked, "k"))


def test_many_requests_past_the_ends(spark, laid):
    """Sweeps go on from row to row, and bounds beyond the table's ends are not in them."""
    asked = spark.range(-3000, 60_000).select(F.col("id").alias("request_id"), (F.col("id") * 3 - 1).alias("lo"), (F.col("id") * 3 + 2).alias("hi"))
    near = lookup.located(laid, asked, "k")
    text = near._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in text.lower()
    got = [tuple(r) for r in near.select("request_id", "first_part", "last_part").orderBy("request_id").collect()]
    ends = [(p * 300, p * 300 + 297) for p in range(40)]
    holds = {i: [p for p in range(max(i // 100 - 1, 0), min(i // 100 + 2, 40)) if ends[p][1] >= i * 3 - 1 and ends[p][0] < i * 3 + 2] for i in range(0, 4000)}
    assert got == [(i, h[0], h[-1]) for i, h in holds.items() if h]
    swept = [r["k"] for r in spark.createDataFrame([(0,), (3,), (4,), (9,), (10,)], "k long").withColumn("n", lookup.places_below(F.col("k"), [3, 4, 4, 9])).where("n <> CASE k WHEN 0 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN 1 WHEN 9 THEN 3 ELSE 4 END").collect()]
    assert not swept


def test_layout_ships_no_checksum(spark, monkeypatch):
    """The checksum of equal keys orders rows and parts ranges, but is no column of what is shuffled; large files have more ranges."""
    seen = []
    write = type(spark.range(1).write).parquet
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, *a, **k: (seen.append(self._df), write(self, *a, **k))[1])
    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    t = ColTable.lay_out(rows, ["k"], ranges=9)
    shuffled = seen[0]._jdf.queryExecution().sparkPlan().toString().split("Exchange")[-1] if seen else ""
    assert seen and "_tie" not in shuffled
    assert len(t.parts) == 9 and t.n_rows == 3000
    order = [r["v"] for r in t.df.orderBy("row_id").collect()]
    want = [r["v"] for r in rows.orderBy("k", F.xxhash64("k", "v")).collect()]
    assert order == want


def test_patched_rows_stay(spark, laid):
    """The rows meet their group's least value where they are."""
    text = plan(codecs.patched(laid.df.select("stripe_id", "row_id", F.col("k").alias("v")))[0])
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_point_lookup_plan(spark, laid):
    asked = spark.createDataFrame([(1, 300), (2, 333), (3, 301), (4, None)], "request_id int, key long")
    df = lookup.batch_lookup(laid, asked, "k", ["g"])
    assert "GreaterThanOrEqual(k,300)" in plan(df) and "LessThanOrEqual(k,333)" in plan(df)
    assert sorted((r["request_id"], r["row_id"]) for r in df.collect()) == [(1, 100), (2, 111)]


def test_empty_requests(spark, laid):
    none = spark.createDataFrame([], "request_id int, lo long, hi long")
    assert lookup.range_rows(laid, none, "k", []).count() == 0
    empty = ColTable.lay_out(spark.createDataFrame([], "k long, g long"), ["k"])
    some = spark.createDataFrame([(1, 0, 9)], "request_id int, lo long, hi long")
    assert lookup.range_rows(empty, some, "k", []).count() == 0


def test_index_lookups(spark, laid):
    asked = spark.createDataFrame([(1, 7), (2, 49), (3, 50), (4, -1), (5, None)], "request_id int, key long")
    want = sorted((i, row) for i, g in ((1, 7), (2, 49)) for row in range(g, 4000, 50))
    index = lookup.HashIndex(laid, "g", 8)
    assert sorted((r["request_id"], r["row_id"]) for r in index.rows(asked, ["k"]).collect()) == want
    assert index.stats().agg(F.sum("rows")).first()[0] == 4000
    assert sorted((r["request_id"], r["row_id"]) for r in lookup.SortedIndex(laid, "g").points(asked).collect()) == want
    ranges = spark.createDataFrame([(1, 3, 5), (2, 48, None)], "request_id int, lo long, hi long")
    got = sorted((r["request_id"], r["row_id"]) for r in lookup.SortedIndex(laid, "g").ranges(ranges).collect())
    assert got == sorted((i, row) for row in range(4000) for i, hit in ((1, 3 <= row % 50 < 5), (2, row % 50 >= 48)) if hit)


def test_starts_and_latest(spark, monkeypatch):
    monkeypatch.setattr(scan, "RUN", 8)
    sizes = [(i * i) % 13 for i in range(100)]
    df = spark.createDataFrame([(i, n, n if n > 9 else None) for i, n in enumerate(sizes)], "i long, n long, m long")
    got = {r["i"]: r["at"] for r in scan.with_starts(df, "i", "n", "at").collect()}
    assert got == {i: sum(sizes[:i]) for i in range(100)}
    got = {r["i"]: r["top"] for r in scan.with_latest(df, "i", "m", "top").collect()}
    assert got == {i: max((n for n in sizes[:i] if n > 9), default=None) for i in range(100)}


def test_hot_key_is_spread(spark):
    """Rows of one key do not fall in one range."""
    rows = spark.range(8000).select(F.lit(1).alias("k"), "id")
    t = ColTable.lay_out(rows, ["k"])
    sizes = [b - a for a, b in zip(t.starts, t.starts[1:], strict=False)]
    assert len(sizes) > 1 and max(sizes) < 6000 and t.n_rows == 8000


def test_double_bits(spark):
    values = [0.0, -0.0, 1.0, -1.0, 1.25, 0.1, 1 / 3, math.pi, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf, 2.0**52 + 1, 0.9999999999999999, 1.0000000000000002, 1e-300, 4.9e-310]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(scalar.double_bits("v")).collect()]
    assert got == [struct.unpack(">q", struct.pack(">d", v))[0] for v in values]
    singles = [0.0, -0.0, 1.0, -2.5, 0.1, 1.4e-45, 1.1754942e-38, 3.4028235e38, math.inf, -math.inf]
    df = spark.createDataFrame([(v,) for v in singles], "v float")
    got = [r[0] for r in df.select(scalar.double_bits("v", True)).collect()]
    assert got == [struct.unpack(">I", struct.pack(">f", v))[0] for v in singles]


def test_split_nanos(spark):
    values = [1676764557984720173, -1676764557984720173, -1, 0, 999, 1000, -1000, -1001, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "t long")
    micros, nanos = scalar.split_nanos("t")
    assert [(r[0], r[1]) for r in df.select(micros, nanos).collect()] == [divmod(v, 1000) for v in values]


def test_split_nanos_past_a_long(spark, tmp_path):
    values = [2**63, -(2**63) - 1, 10**21 + 7, -(10**21) - 7, 9 * 10**21 + 999, -1, 0, 1000, 2**63 - 1, 1000 * 2**63 - 1, -1000 * 2**63]
    df = spark.createDataFrame([(Decimal(v),) for v in values], "t decimal(38,0)")
    micros, nanos = scalar.split_nanos("t", wide=True)
    out = df.select(micros.alias("m"), nanos.alias("n"))
    assert out.schema.simpleString() == "struct<m:bigint,n:bigint>"
    assert [(r[0], r[1]) for r in out.collect()] == [divmod(v, 1000) for v in values]
    with pytest.raises(Exception, match="OVERFLOW"):
        spark.createDataFrame([(Decimal(1000 * 2**63),)], "t decimal(38,0)").select(micros).collect()
    spark.createDataFrame([(7, 90_000), (8, 1499), (9, 0)], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: (r["micros"], r["nanos"]) for r in scan_queries.fn_05_timestamp_split(spark, str(tmp_path)).collect()}
    assert got == {e: divmod((u - 70) * 27764557984720173 + e, 1000) for e, u in ((7, 90_000), (8, 1499), (9, 0))}


def test_range_keeps_no_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (-1.0,), (None,)], "v double")
    for f, want in ((filters.Range(0, None), [1.0]), (filters.Range(0.0, None, lower_open=True), [1.0]), (filters.Range(None, 0), [-1.0]), (filters.Range(0, None, null_allowed=True), [1.0, None])):
        assert [r[0] for r in df.where(f.condition("v")).collect()] == want


def test_packed_widths(spark):
    """All widths from none to 63 bits, and frames cut at any place."""
    rows = [(s, 100 * s + i, (2**w - 1) // (i + 1) - (5 if s % 2 else 0)) for s, w in enumerate([0, 1, 2, 5, 7, 8, 13, 16, 31, 32, 33, 47, 62, 63]) for i in range(37)]
    df = spark.createDataFrame(rows, "stripe_id long, row_id long, v long")
    for size in (32, 10, 64):
        for coded in (codecs.fixed_width(df, size), codecs.blocks(df, size)):
            assert sorted((r["stripe_id"], r["row_id"], r["v"]) for r in codecs.unpacked(coded).collect()) == rows
    assert sorted((r["stripe_id"], r["row_id"], r["v"]) for r in codecs.varints_decode(codecs.varints(df, 16)).collect()) == rows


def test_huffman_limit():
    """Fibonacci counts need codes of many bits; those kept are of twelve at most, and still tell values apart."""
    counts, a, b = {}, 1, 1
    for i in range(40):
        counts[i], a, b = a, b, a + b
    lengths = codecs.limited(codecs.huffman_lengths(list(counts.items())), counts)
    assert max(lengths.values()) == codecs.LONGEST and sum(2.0 ** -n for n in lengths.values()) <= 1
    codes = sorted(codecs.canonical(lengths).values())
    assert all(not y.startswith(x) for x, y in zip(codes, codes[1:], strict=False))
    with pytest.raises(ValueError):
        codecs.limited({i: 13 for i in range(5000)}, dict.fromkeys(range(5000), 1))


def test_parts_and_finished_tables(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "k long, g long")
    path = f"file://{tmp_path}/parts"
    for _ in range(2):  # a batch that is given again replaces itself
        writer.append(df, path, 0)
    writer.append(df, path, 1)
    assert spark.read.parquet(f"{path}/data").count() == 20
    path = f"file://{tmp_path}/whole"
    writer.write(df, path, ["k"], writer.WriterOptions.parse({"stripe_rows": "4"}))
    with pytest.raises(ValueError, match="finished"):
        writer.append(df, path, 0)
    with pytest.raises(ValueError, match="finished"):
        writer.abort(spark, path)
    again = ColTable.open(spark, path)
    assert again.n_rows == 10 and again.n_stripes == 3 and [r["k"] for r in again.select(["k"], 2, 5).collect()] == [5, 6]
    half = f"file://{tmp_path}/half"
    df.write.parquet(f"{half}/data")
    with pytest.raises(Exception, match="metadata|PATH_NOT_FOUND"):
        ColTable.open(spark, half)
    writer.abort(spark, half)
    import os

    assert not os.path.exists(f"{tmp_path}/half")


def test_cache_follows_files(spark, tmp_path):
    from laminar.table import cached

    path = f"file://{tmp_path}/t"
    spark.range(5).write.parquet(path)
    assert cached(spark, path, ["id"]).n_rows == 5 and cached(spark, path, ["id"]) is cached(spark, path, ["id"])
    spark.range(7).write.mode("overwrite").parquet(path)
    assert cached(spark, path, ["id"]).n_rows == 7


def test_flush_hysteresis():
    test = writer.memory_policy(100, 10**9, 1.0, low=40)
    sizes = [test({"bytes": b}) for b in (90, 100, 39, 40, 50)]
    assert sizes == [False, True, False, True, True]
    pressed = writer.memory_policy(100, 60, 1.0, low=40)
    assert [pressed({"bytes": b}) for b in (59, 60)] == [False, True]


def test_timestamps_order(spark):
    rows = [(datetime.datetime(2020, 1, 1 + i), i) for i in range(20)]
    t = ColTable.lay_out(spark.createDataFrame(rows, "at timestamp_ntz, v int"), ["at"], chunk_rows=3)
    asked = spark.createDataFrame([(1, rows[4][0], rows[9][0])], "request_id int, lo timestamp_ntz, hi timestamp_ntz")
    assert sorted(r["v"] for r in lookup.range_rows(t, asked, "at", ["v"]).collect()) == [4, 5, 6, 7, 8]
