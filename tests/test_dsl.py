"""The inspection language: what its text compiles to, and what it says of text that is no command."""

import pytest

from laminar.plans import dsl
from laminar.table import ColTable


@pytest.fixture(scope="module")
def people(spark):
    df = spark.createDataFrame([(1001, "Alice", 95.5), (1002, "Bob", 87.3), (1003, "Charlie", 92.1)], "user_id long, name string, score double")
    return ColTable.lay_out(df, ["user_id"], stripe_rows=2, chunk_rows=2)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("select a, b limit 5 offset 10 stripe 1;", dict(op="select", columns=["a", "b"], limit=5, offset=10, stripe=1)),
        ("SELECT *", dict(op="select", columns=[], limit=20, offset=0, stripe=None)),
        ("SELECT * a", dict(columns=["a"])),
        ("SELECT a,b FROM t LIMIT 3", dict(columns=["a", "b"], limit=3)),
        ("SELECT a LIMIT", dict(columns=["a"], limit=20)),
        ("SELECT limit a", dict(columns=["a"])),
        ("show content 3 stripe 2", dict(op="content", stream=3, stripe=2)),
        ("SHOW HISTOGRAM TOP 4", dict(op="histogram", top=4)),
        ("Show File Layout", dict(op="layout")),
        ("exit", dict(op="quit")),
    ],
)
def test_compile(text, want):
    got = dsl.compile_text(text)
    assert {k: getattr(got, k) for k in want} == want


@pytest.mark.parametrize("text", ["", "DROP t", "SHOW", "SHOW TABLES", "SHOW CONTENT", "SHOW CONTENT x"])
def test_errors(text):
    with pytest.raises(dsl.DslError):
        dsl.compile_text(text)


def test_select(people):
    assert [tuple(r) for r in dsl.run(people, "SELECT name, user_id OFFSET 1").collect()] == [("Bob", 1002), ("Charlie", 1003)]
    assert [r["name"] for r in dsl.run(people, "SELECT name STRIPE 1").collect()] == ["Charlie"]
    assert dsl.run(people, "SELECT name OFFSET 9").collect() == []
    with pytest.raises(dsl.DslError, match="DESCRIBE"):
        dsl.run(people, "SELECT nothing")
    with pytest.raises(dsl.DslError):
        dsl.run(people, "SELECT name STRIPE 2")
    assert dsl.run(people, "QUIT") is None


def test_show(people):
    assert {r["column"]: (r["type"], r["stream"]) for r in dsl.run(people, "DESCRIBE").collect()} == {"user_id": ("long", 1), "name": ("string", 2), "score": ("double", 3)}
    assert [(r["stripe_id"], r["rows"]) for r in dsl.run(people, "SHOW STRIPES").orderBy("stripe_id").collect()] == [(0, 2), (1, 1)]
    assert {r["column"] for r in dsl.run(people, "SHOW ENCODING").collect()} == {"user_id", "name", "score"}
    assert dsl.run(people, "SHOW HISTOGRAM TOP 1").count() == 1
    assert dsl.run(people, "SHOW OPTIONAL SECTIONS").count() == 4
    assert dsl.run(people, "SHOW INDEX").agg({"rows": "sum"}).first()[0] == 3
