"""Policies, symbol tables, the data source and the registry of indexes."""

import json

import pytest
from pyspark.sql import functions as F

from laminar.operators import policies, symbols
from laminar.plans import indexes
from laminar.sources import connector, writer
from laminar.table import ColTable


@pytest.fixture(scope="module")
def t(spark):
    df = spark.createDataFrame([(i, i % 3, f"name of {i % 5}") for i in range(300)], "k long, a int, s string")
    return ColTable.lay_out(df, ["k"], 100, 50)


def test_policies(t):
    chosen = policies.cost_based()(t.df, ["a", "s"])
    layout = policies.capture(chosen)
    assert set(json.loads(layout)) == {"a", "s"}
    forced = policies.replayed(json.dumps({"a": "Varint", "s": "Nothing"}))(t.df, ["a", "s"])
    got = {(r["column"], r["encoding"]) for r in forced.collect()}
    assert ("a", "Varint") in got and len(got) == 2
    memo = {}
    pick = policies.remembered(policies.random_choice(3), memo)
    first = sorted(map(tuple, pick(t.df, ["a"]).collect()))
    assert first == sorted(map(tuple, pick(t.df, ["a"]).collect())) and set(memo) == {"a"}
    small = policies.learned(lambda encoding, size: size)(t.df, ["a"]).collect()
    assert len(small) == 3


def test_symbols(t):
    rows = t.df.select("stripe_id", "row_id", F.when(F.col("k") != 7, F.col("s")).alias("v"))
    table, coded = symbols.compress(rows)
    back = {r["row_id"]: r["v"] for r in symbols.expand(coded, table).collect()}
    assert back == {r["row_id"]: r["v"] for r in rows.collect()}
    assert symbols.sizes(rows).first()["kept"]
    for data in (b"", b"\xff\x00abc", "né".encode(), bytes(range(256))):
        assert symbols.decode(symbols.encode(data, table), table) == data


def test_connector(spark, t, tmp_path):
    path = f"file://{tmp_path}/t"
    writer.write(t.df.select("k", "a", "s"), path, ["k"])
    connector.register(spark)
    df = spark.read.format("laminar").load(path)
    assert df.count() == 300
    assert sorted(r["k"] for r in df.where("k >= 295 AND a = 1").collect()) == [k for k in range(295, 300) if k % 3 == 1]
    assert writer.compression_rate(spark, path).first()["rate"] > 0


def test_indexes(spark, t):
    assert indexes.kind("cluster").build(t, "k").count() == 3
    asked = spark.createDataFrame([(1, 5), (2, 999)], "request_id long, key long")
    assert [(r["request_id"], r["start_row"], r["end_row"]) for r in indexes.kind("cluster").points(t, asked, "k").collect()] == [(1, 5, 6)]
    spans = spark.createDataFrame([(1, 5, 8), (2, 9, 9), (3, None, 2)], "request_id long, lo long, hi long")
    got = sorted((r["request_id"], r["row_id"]) for r in indexes.kind("sorted").ranges(t, spans, "k").collect())
    assert got == [(1, 5), (1, 6), (1, 7), (3, 0), (3, 1)]
    with pytest.raises(KeyError):
        indexes.kind("none")
    with pytest.raises(ValueError):
        indexes.register("hash", indexes.kind("hash"))
