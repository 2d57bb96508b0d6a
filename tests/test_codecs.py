"""Encodings give their input back, and filters, bounds, writers and streams keep their rules."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from laminar.functions import scalar
from laminar.operators import advisor, codecs, dedup, lookup, ranges, scan
from laminar.operators import filters as P
from laminar.sources import batches, writer
from laminar.streaming.appender import append_stream
from laminar.table import ColTable


def values(spark, vs, kind="long", stripe=7):
    return spark.createDataFrame([(i // stripe, i, v) for i, v in enumerate(vs)], f"stripe_id long, row_id long, v {kind}")


def back(df):
    return [r["v"] for r in df.orderBy("row_id").collect()]


PATTERNS = {
    "constant": [5] * 20, "rising": list(range(0, 60, 3)), "mixed": [1, 2, 4, 1, 2, 3, 4, 1, 2, 4, 8, 8], "signed": [-5, 3, -1, 0, 7, 7, -5], "one": [9],
}


@pytest.mark.parametrize("name", PATTERNS)
def test_integers(spark, name):
    vs = PATTERNS[name]
    rows = values(spark, vs)
    assert back(codecs.rle_decode(codecs.rle(rows))) == vs
    assert back(codecs.dictionary_decode(*codecs.dictionary(rows))) == vs
    assert back(codecs.delta_decode(codecs.delta(rows))) == vs
    assert back(codecs.frames_decode(codecs.frames(rows, 4))) == vs
    assert back(codecs.mainly_constant_decode(*codecs.mainly_constant(rows), rows)) == vs
    if min(vs) >= 0:
        assert back(codecs.bit_ranges_decode(codecs.bit_ranges(rows, [0, 2, 5]), [0, 2, 5])) == vs


def test_delta_example(spark):
    rows = values(spark, PATTERNS["mixed"], stripe=100)
    got = [(r["restated"], r["value"]) for r in codecs.delta(rows).orderBy("row_id").collect()]
    assert "".join("T" if t else "F" for t, _ in got) == "TFFTFFFTFFFF"
    assert [v for t, v in got if not t] == [1, 2, 1, 1, 1, 1, 2, 4, 0]


def test_nulls(spark):
    vs = [None, 3, None, None, 8, 8, None, 1]
    rows = values(spark, vs)
    assert back(codecs.nullable_decode(*codecs.nullable(rows))) == vs
    assert back(codecs.sentinel_decode(codecs.sentinel(rows))) == vs


def test_doubles(spark):
    vs = [1.25, 0.1, 3.14159, 1e300, -2.5, 0.0]
    assert back(codecs.alp_decode(codecs.alp(values(spark, vs, "double"), 2), 2)) == vs


def test_huffman_length_counts():
    """Lengths from the histogram of counts are as cheap as those from the values, one by one."""
    rng = random.Random(5)
    for trial in range(300):
        own = [rng.choice([1, 1, 1, 2, 2, 3, rng.randint(1, 10 ** rng.randint(1, 5))]) for _ in range(rng.randint(1, 90))]
        slow = codecs.huffman_lengths(list(enumerate(own)))
        held = codecs.huffman_length_counts(dict(Counter(own)))
        spread = [n for n, m in sorted(held.items()) for _ in range(m)]
        assert len(spread) == len(own) and (len(own) == 1 or sum(2.0**-n for n in spread) == 1)
        assert sum(a * b for a, b in zip(sorted(own, reverse=True), spread, strict=True)) == sum(own[i] * n for i, n in slow.items()), trial


def test_huffman_of_many_values(spark):
    """More values than one task holds: frequent ones have the shorter codes, no code begins another, and rows come back."""
    held = [v for v in range(codecs.HUFFMAN_VALUES + 900) for _ in range(1 + (v % 7 == 0) + 300 * (v < 3))]
    rows = values(spark, held)
    codes = codecs.huffman(rows.select("v"))
    own = codes.collect()
    assert len(own) == codecs.HUFFMAN_VALUES + 900 and all(len(r["code"]) == r["code_length"] for r in own)
    order = sorted(r["code"] for r in own)
    assert not any(b.startswith(a) for a, b in zip(order, order[1:]))
    slow = codecs.huffman_lengths(list(Counter(held).items()))
    assert sum(r["n"] * r["code_length"] for r in own) == sum(n * slow[v] for v, n in Counter(held).items())
    back = codecs.huffman_decode(codecs.huffman_encode(rows, codes), codes)
    assert sorted((r["row_id"], r["v"]) for r in back.collect()) == list(enumerate(held))
    words = rows.withColumn("v", F.concat(F.lit("w"), F.col("v").cast("string")))
    codes = codecs.huffman(words.select("v"))
    back = codecs.huffman_decode(codecs.huffman_encode(words, codes), codes)
    assert sorted((r["row_id"], r["v"]) for r in back.collect()) == [(i, f"w{v}") for i, v in enumerate(held)]


def test_huffman(spark):
    got = {r["v"]: r["code_length"] for r in codecs.huffman(values(spark, [1] * 8 + [2] * 4 + [3] * 2 + [4] * 2)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3}
    assert sum(2.0**-n for n in got.values()) == 1


def test_zigzag(spark):
    df = spark.createDataFrame([(v,) for v in (0, -1, 1, -2, 2, 2**40, -(2**62))], "v long")
    rows = df.select("v", scalar.zigzag("v").alias("z")).select("v", "z", scalar.unzigzag("z").alias("b")).collect()
    assert [r["z"] for r in rows][:5] == [0, 1, 2, 3, 4]
    assert all(r["v"] == r["b"] for r in rows)


def test_pack(spark):
    rows = spark.createDataFrame([(i, i * 7 % 13) for i in range(20)], "i long, v long")
    words = scalar.pack(rows, 4, 8)
    assert [r["v"] for r in scalar.unpack(words, 4, 8).where("i < 20").orderBy("i").collect()] == [i * 7 % 13 for i in range(20)]


def test_choice(spark):
    def chosen(vs, kind="long"):
        df = values(spark, vs, kind, stripe=10**6)
        return advisor.choose(advisor.estimates(df, "v"), ["stripe_id"]).first()["encoding"]

    assert chosen([4] * 500) == "Constant"
    assert chosen(["ab"] * 500, "string") == "Constant"
    assert chosen([True] * 3 + [False] * 4000, "boolean") == "SparseBool"
    assert chosen([1] * 400 + [2**50] * 400) == "RLE"
    assert advisor.parse_read_factors("RLE=2;Trivial=0.5") == {"RLE": 2.0, "Trivial": 0.5}
    with pytest.raises(ValueError):
        advisor.parse_read_factors("Nope=1")
    assert [p for p, _, _ in advisor.cascade(values(spark, [1] * 400 + [2**50] * 400, stripe=10**6), "v")][0] == "v"


def test_bounds():
    keys, up = ["a", "b", "c"], [True, True, False]
    got = P.to_bounds(keys, up, {"a": P.Range(1, 1), "b": P.Range(2, 9), "c": P.Range(0, 5)})
    assert (got.columns, got.lower, got.upper, list(got.left)) == (["a", "b"], [1, 2], [1, 9], ["c"])
    got = P.to_bounds(keys, up, {"a": P.Range(1, 1), "b": P.Range(2, 2), "c": P.Range(0, 5)})
    assert (got.lower[2], got.upper[2]) == (5, 0)
    assert P.to_bounds(keys, up, {"b": P.Range(1, 1)}) is None
    assert P.to_bounds(keys, up, {"a": P.Range(1, 1, null_allowed=True)}) is None
    assert P.to_bounds(keys, up, {"a": P.Values([1, 2])}) is None
    assert P.to_bounds(["s"], [False], {"s": P.Range("a", "b")}, strings=["s"]) is None


def test_table(spark):
    t = ColTable.lay_out(spark.createDataFrame([(i * 3 % 101, str(i)) for i in range(101)], "k long, s string"), ["k"], 10, 4)
    assert [r["k"] for r in t.df.orderBy("row_id").collect()] == list(range(101))
    assert [r["k"] for r in t.rows(95, 500).orderBy("row_id").collect()] == list(range(95, 101))
    assert t.rows(7, 3).count() == 0 and t.stripe(10).count() == 1 and t.stripe(-1).count() == 0
    assert t.skip(200)[1] == 101 and t.from_row(500).first()["k"] == 100
    empty = ColTable.lay_out(spark.createDataFrame([], "k long"), ["k"])
    assert empty.n_rows == 0 and empty.df.count() == 0 and empty.select().count() == 0
    hits = lookup.batch_lookup_clipped(t, spark.createDataFrame([(1, 5, 9), (2, 50, 50)], "request_id long, start_row long, end_row long"), ["k"], 2)
    assert sorted((r["request_id"], r["k"]) for r in hits.collect()) == [(1, 5), (1, 6)]


def test_ranges(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 9), (1, 8, 10), (1, 9, 12)], "g long, start_row long, end_row long")
    assert sorted((r["start_row"], r["end_row"]) for r in ranges.union(df, "g").collect()) == [(0, 7), (8, 12)]
    assert sorted((r["start_row"], r["end_row"], r["covering"]) for r in ranges.split(df, "g").collect()) == [(0, 5, 1), (5, 7, 1), (8, 9, 1), (9, 10, 2), (10, 12, 1)]


def test_dedup(spark):
    df = spark.createDataFrame([(0, i, a) for i, a in enumerate([[1], [1], None, None, [2], [1]])], "g long, i long, a array<int>")
    marked = dedup.consecutive(df, "a", "g", "i")
    assert [r["is_new"] for r in marked.orderBy("i").collect()] == [True, False, True, True, True, True]
    whole = dedup.restore(marked, dedup.stored(marked, "a", "g"), "a", "g")
    assert [r["a"] for r in whole.orderBy("i").collect()] == [[1], [1], None, None, [2], [1]]


def test_evolve(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert scan.evolve(df, "a bigint, c string").first().asDict() == {"a": 1, "c": None}
    with pytest.raises(TypeError):
        scan.evolve(df.select(F.col("a").cast("long")), "a int")


def test_writer(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(50)], "k long, n string")
    path = f"file://{tmp_path}/t"
    writer.write(df, path, ["k"], writer.WriterOptions.parse({"stripe_rows": "20", "owner": "me"}))
    assert spark.read.parquet(f"{path}/data").count() == 50
    assert writer.metadata(spark, path)["owner"] == "me" and writer.verify(spark, path)
    t = ColTable.lay_out(df, ["k"], 10, 5)
    assert writer.cut_by_size(t, 1, None).select("stripe").distinct().count() == 10
    assert writer.cut_by_size(t, 0, writer.memory_policy(10**9, 10**9, 2.0)).select("stripe").distinct().count() == 1
    probes = spark.createDataFrame([(i,) for i in range(200)], "key long")
    bits = writer.bloom_bits(50)
    kept = writer.may_hold(writer.bloom(df.withColumnRenamed("k", "key"), "key", bits), probes, "key", bits)
    found = {r["key"]: r["maybe"] for r in kept.collect()}
    assert all(found[i] for i in range(50)) and sum(found[i] for i in range(50, 200)) < 15


def test_batches(spark):
    df = spark.createDataFrame([(i, str(i), [float(i)]) for i in range(25)], "a long, b string, c array<double>")
    packed = batches.serialize(df.coalesce(1), 10)
    assert packed.count() == 3
    assert sorted(r["a"] for r in batches.deserialize(packed, df.schema, 1, 2).collect()) == [1, 2, 11, 12, 21, 22]
    assert batches.project(packed, df.schema, ["c", "a"], ["x", "y"]).columns == ["x", "y"]
    with pytest.raises(KeyError):
        batches.project(packed, df.schema, ["z"])


def test_stream(spark, tmp_path):
    spark.createDataFrame([(i, i % 3) for i in range(30)], "event_id long, user long").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, user long").parquet(f"file://{tmp_path}/in")
    q = append_stream(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", "user", "event_id", 4)
    q.awaitTermination(60)
    out = spark.read.parquet(f"file://{tmp_path}/out/data")
    assert out.count() == 30 and out.agg(F.max("part")).first()[0] == 2


def test_streams_are_read_in_place():
    """Many serialized batches come at once; they are not copied before the first is opened."""
    import tracemalloc

    import pyarrow as pa

    schema = pa.schema([("a", pa.int64()), ("b", pa.string())])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_batch(pa.record_batch([pa.array(range(20_000)), pa.array(["x" * 5] * 20_000)], schema=schema))
    data = sink.getvalue().to_pybytes()
    part = pa.record_batch([pa.array([data] * 60, pa.binary())], ["data"])
    wanted = pa.schema([("b", pa.string())])
    tracemalloc.start()
    got = [x.num_rows for x in batches.opener(["b"], wanted, 5, 10)(iter([part]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [10] * 60 and peak < len(data) * 10
