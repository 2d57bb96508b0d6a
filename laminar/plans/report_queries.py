"""Reports over the star schema, in the shapes of a well-known decision-support benchmark: each query with its SQL.

Amounts are summed as decimals of four places, which the products have, so that sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminar.plans.tables import read

Q: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


def _money(c: Column) -> Column:
    return F.sum(c.cast("decimal(18,4)")).cast("double")


def _net() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


NET = "CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE)"


def _time(day: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{day}'")


def _between(c: str, first: str, end: str) -> Column:
    return (F.col(c) >= _time(first)) & (F.col(c) < _time(end))


def _national(spark, d: str) -> DataFrame:
    return read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


@query(
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS sum_base, "
    f"{NET} AS sum_net, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) / count(*) AS DOUBLE) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"
)
def report_01_pricing(spark, d):
    rows = read(spark, d, "lineitem").where(F.col("l_shipdate") <= _time("1998-09-02")).groupBy("l_returnflag", "l_linestatus")
    mean = (F.sum(F.col("l_quantity").cast("decimal(18,4)")).cast("double") / F.count("*")).alias("avg_qty")
    return rows.agg(F.sum("l_quantity").alias("sum_qty"), _money(F.col("l_extendedprice")).alias("sum_base"), _money(_net()).alias("sum_net"), mean, F.count("*").alias("n"))


@query(
    f"SELECT n_name, {NET} AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey "
    "JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY n_name"
)
def report_05_local_suppliers(spark, d):
    nations = _national(spark, d).where("r_name = 'ASIA'").select("n_nationkey", "n_name")
    sold = read(spark, d, "orders").where(_between("o_orderdate", "1994-01-01", "1997-01-01")).join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = sold.join(read(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    own = lines.join(read(spark, d, "supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return own.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(_money(_net()).alias("revenue"))


@query("SELECT CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24")
def report_06_forecast(spark, d):
    rows = read(spark, d, "lineitem").where(_between("l_shipdate", "1994-01-01", "1995-01-01") & F.col("l_discount").between(0.045, 0.075) & (F.col("l_quantity") < 24))
    return rows.agg(_money(F.col("l_extendedprice") * F.col("l_discount")).alias("revenue"))


@query(
    f"SELECT s.n_name AS supplier_nation, c.n_name AS customer_nation, CAST(year(l_shipdate) AS INT) AS year, {NET} AS revenue FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey "
    "JOIN nation s ON s_nationkey = s.n_nationkey JOIN nation c ON c_nationkey = c.n_nationkey WHERE s.n_nationkey < 5 AND c.n_nationkey < 5 AND s.n_nationkey <> c.n_nationkey GROUP BY ALL"
)
def report_07_volume(spark, d):
    few = read(spark, d, "nation").where("n_nationkey < 5")
    sellers = few.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supplier_nation")).join(read(spark, d, "supplier"), "s_nationkey")
    buyers = few.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_nation")).join(read(spark, d, "customer"), "c_nationkey")
    bought = read(spark, d, "orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    lines = read(spark, d, "lineitem").join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
    across = lines.where("s_nationkey <> c_nationkey").groupBy("supplier_nation", "customer_nation", F.year("l_shipdate").alias("year"))
    return across.agg(_money(_net()).alias("revenue"))


@query(
    f"SELECT c_custkey, c_name, {NET} AS revenue, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY ALL ORDER BY revenue DESC, c_custkey LIMIT 20"
)
def report_10_returns(spark, d):
    """The twenty customers with most returned: a top-k report."""
    lines = read(spark, d, "lineitem").where("l_returnflag = 'R'").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lost = lines.groupBy("o_custkey").agg(_money(_net()).alias("revenue"))
    named = lost.join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.orderBy(F.desc("revenue"), "c_custkey").limit(20).select("c_custkey", "c_name", "revenue", "n_name")


@query("SELECT p_type, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1995-09-01' AND l_shipdate < TIMESTAMP '1995-10-01' GROUP BY p_type")
def report_14_types(spark, d):
    rows = read(spark, d, "lineitem").where(_between("l_shipdate", "1995-09-01", "1995-10-01")).join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("p_type").agg(_money(_net()).alias("revenue"), F.count("*").alias("n"))


@query(
    f"WITH r AS (SELECT l_suppkey, {NET} AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY 1) SELECT s_suppkey, s_name, revenue FROM supplier JOIN r ON s_suppkey = l_suppkey WHERE revenue = (SELECT max(revenue) FROM r)"
)
def report_15_top_supplier(spark, d):
    by = read(spark, d, "lineitem").where(_between("l_shipdate", "1996-01-01", "1996-04-01")).groupBy("l_suppkey").agg(_money(_net()).alias("revenue"))
    top = by.agg(F.max("revenue").alias("revenue"))
    return by.join(top, "revenue").join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_suppkey", "s_name", "revenue")


@query(
    "SELECT c_custkey, o_orderkey, o_totalprice, sum(l_quantity) AS quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL HAVING sum(l_quantity) > 250"
)
def report_18_large_orders(spark, d):
    large = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity")).where("quantity > 250")
    named = read(spark, d, "orders").join(large, F.col("o_orderkey") == F.col("l_orderkey")).join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return named.select("c_custkey", "o_orderkey", "o_totalprice", "quantity")
