"""Scans, projections, filters, limits and order: each query with the SQL that gives its rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from laminar.functions import scalar
from laminar.operators import filters as P
from laminar.operators import project, scan
from laminar.plans.dsl import run as dsl
from laminar.plans.tables import numbered, read, table

L, O, E = numbered("lineitem"), numbered("orders"), numbered("events")
Q: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


# Scans.


@query("SELECT * FROM orders")
def scan_01_batch(spark, d):
    return read(spark, d, "orders")


@query("SELECT l_orderkey, l_extendedprice, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.03 AND 0.05 AND l_quantity < 10")
def scan_02_selective(spark, d):
    keep = [P.timestamp_range("l_shipdate", lower="1995-01-01"), P.double_range("l_discount", 0.03, 0.05), P.double_range("l_quantity", None, 10, upper_open=True)]
    return scan.selective(read(spark, d, "lineitem"), ["l_orderkey", "l_extendedprice", "l_shipdate"], keep)


@query(f"SELECT row_id, l_orderkey, l_extendedprice FROM {L} WHERE stripe_id = 2")
def scan_03_stripe(spark, d):
    return table(spark, d, "lineitem").stripe(2).select("row_id", "l_orderkey", "l_extendedprice")


_EVENT_SIZE = "octet_length(encode(event_type)) + octet_length(encode(props)) + 32"


@query(
    f"WITH s AS (SELECT stripe_id, sum({_EVENT_SIZE})::BIGINT AS size FROM {E} GROUP BY 1), o AS (SELECT stripe_id, size, coalesce(sum(size) OVER (ORDER BY stripe_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM s) "
    f"SELECT e.event_id, e.stripe_id, o.start AS stripe_offset FROM {E} e JOIN o USING (stripe_id) WHERE o.start >= 100000 AND o.start < 400000"
)
def scan_04_split(spark, d):
    return scan.split(table(spark, d, "events"), ["event_type", "props"], 32, 100_000, 400_000).select("event_id", "stripe_id", "stripe_offset")


@query(f"SELECT row_id, o_orderkey FROM {O} WHERE row_id >= least(14000, (SELECT count(*) - 1 FROM orders))")
def scan_05_seek(spark, d):
    return table(spark, d, "orders").from_row(14_000).select("row_id", "o_orderkey")


@query(f"SELECT row_id, o_orderkey, least(12345, (SELECT count(*) FROM orders))::BIGINT AS skipped FROM {O} WHERE row_id >= 12345")
def scan_06_skip(spark, d):
    rows, n = table(spark, d, "orders").skip(12_345)
    return rows.select("row_id", "o_orderkey", F.lit(n).cast("long").alias("skipped"))


@query(f"SELECT row_id, event_id, event_type FROM {E}")
def scan_07_row_number(spark, d):
    return table(spark, d, "events").df.select("row_id", "event_id", "event_type")


@query(f"SELECT row_id, event_id, value FROM {E} WHERE row_id % 7 = 3")
def scan_08_sample(spark, d):
    return scan.every(table(spark, d, "events"), 7, 3).select("row_id", "event_id", "value")


@query(f"SELECT o_orderkey, o_totalprice FROM {O} WHERE NOT (row_id % 5 = 0 OR row_id BETWEEN 100 AND 220)")
def scan_09_deleted_rows(spark, d):
    t = table(spark, d, "orders")
    mask = t.df.where((F.col("row_id") % 5 == 0) | F.col("row_id").between(100, 220)).select("row_id")
    return t.scan(["o_orderkey", "o_totalprice"], deleted=mask)


@query("SELECT c_custkey, NULL::DOUBLE AS c_score, NULL::VARCHAR AS c_note FROM customer")
def scan_10_missing_columns(spark, d):
    return scan.evolve(read(spark, d, "customer"), "c_custkey bigint, c_score double, c_note string")


@query("SELECT p_partkey, p_size::BIGINT AS p_size, p_retailprice::FLOAT::DOUBLE AS price FROM part")
def scan_11_widen(spark, d):
    narrow = read(spark, d, "part").select("p_partkey", "p_size", F.col("p_retailprice").cast("float").alias("price"))
    return scan.evolve(narrow, "p_partkey bigint, p_size bigint, price double")


@query("SELECT count(*) AS n_rows FROM lineitem")
def scan_12_row_count(spark, d):
    return read(spark, d, "lineitem").agg(F.count("*").alias("n_rows"))


@query(f"SELECT row_id, o_orderpriority AS value FROM {O} WHERE stripe_id = 1 AND o_orderstatus = 'F'")
def scan_13_stream(spark, d):
    t = table(spark, d, "orders")
    return scan.stream(t.stripe(1), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")))


@query("SELECT greatest(1, floor(sum(8 + 8 + octet_length(encode(o_orderstatus)) + 8 + 12 + octet_length(encode(o_orderpriority))) / count(*)))::BIGINT AS row_size FROM orders")
def scan_15_row_size(spark, d):
    return scan.row_size(read(spark, d, "orders"))


@query(
    f"SELECT stripe_id, count(*) AS n, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS clicks, min(ts) AS first_ts, max(user_id) AS last_user FROM {E} GROUP BY stripe_id"
)
def scan_16_kinds(spark, d):
    t = table(spark, d, "events")
    return t.df.groupBy("stripe_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.min("ts").alias("first_ts"), F.max("user_id").alias("last_user"))


# Limits, and the inspection language's SELECT.


@query(f"SELECT l_orderkey, l_extendedprice FROM {L} WHERE stripe_id = 2 ORDER BY row_id LIMIT 5 OFFSET 100")
def sort_01_limit_offset_stripe(spark, d):
    return dsl(table(spark, d, "lineitem"), "SELECT l_orderkey, l_extendedprice LIMIT 5 OFFSET 100 STRIPE 2;")


@query(f"SELECT o_orderkey, o_custkey FROM {O} ORDER BY row_id LIMIT 20")
def meta_01_select_default(spark, d):
    return dsl(table(spark, d, "orders"), "select o_orderkey o_custkey from orders")


@query(f"SELECT * EXCLUDE (row_id, stripe_id, chunk_id) FROM {O} WHERE stripe_id = 3 ORDER BY row_id LIMIT 100 OFFSET 2990")
def sort_02_limit_in_stripe(spark, d):
    return table(spark, d, "orders").select(None, limit=100, offset=2990, stripe=3)


@query("WITH k AS (SELECT o_custkey AS k, lag(o_custkey) OVER (ORDER BY o_orderkey) AS p FROM orders) SELECT count(*) FILTER (k < p) AS out_of_order, count(*) FILTER (k = p) AS repeated FROM k")
def sort_03_key_order(spark, d):
    return scan.key_order(table(spark, d, "orders"), "o_custkey")


@query(f"SELECT o_custkey, row_id, row_number() OVER (ORDER BY o_custkey, row_id) - 1 AS entry FROM {O}")
def sort_04_secondary_order(spark, d):
    return scan.secondary(table(spark, d, "orders"), "o_custkey")


@query("SELECT (c_custkey % 16)::BIGINT AS bucket, count(*) AS n, min(c_custkey) AS lo, max(c_custkey) AS hi FROM customer GROUP BY 1")
def sort_05_buckets(spark, d):
    return scan.buckets(read(spark, d, "customer"), "c_custkey", 16)


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey ASC, c_mktsegment DESC, c_custkey DESC) - 1 AS place FROM customer")
def sort_06_composite_order(spark, d):
    return scan.composite_order(read(spark, d, "customer"), [("c_nationkey", True), ("c_mktsegment", False), ("c_custkey", False)]).select("c_custkey", "place")


# Projections. Maps are built for each user: event type to the number of its events.

MAPS = "SELECT user_id, map_from_entries(list((event_type, n) ORDER BY event_type)) AS m FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id"
TYPES = "SELECT user_id, coalesce(sum(n) FILTER (event_type = '{0}'), NULL)::BIGINT AS {0} FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id"


def maps(spark, d):
    n = read(spark, d, "events").groupBy("user_id", "event_type").count()
    return n.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "count")))).alias("m"))


@query("SELECT o_custkey, o_orderdate, o_orderkey FROM orders")
def proj_01_columns(spark, d):
    return read(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")


@query("SELECT event_id, event_type AS kind, user_id AS who, value + 1 AS up FROM events")
def proj_03_nested(spark, d):
    nested = read(spark, d, "events").select("event_id", F.struct(F.col("event_type").alias("kind"), F.struct(F.col("user_id").alias("who"), (F.col("value") + 1).alias("up")).alias("in")).alias("st"))
    return project.subfields(nested, ["event_id", "st.kind", "st.in.who", "st.in.up"])


@query(f"SELECT user_id, list_sort(list_filter(map_keys(m), lambda k: k IN ('click', 'view'))) AS ks, coalesce(m['click'], 0) + coalesce(m['view'], 0) AS n FROM ({MAPS})")
def proj_04_keys_include(spark, d):
    kept = project.keys(maps(spark, d), "m", ["click", "view", "none"])
    return kept.select("user_id", F.array_sort(F.map_keys("m")).alias("ks"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))


@query(f"SELECT user_id, list_sort(list_filter(map_keys(m), lambda k: k NOT IN ('click', 'view'))) AS ks FROM ({MAPS})")
def proj_05_keys_exclude(spark, d):
    return project.keys(maps(spark, d), "m", ["click", "view"], mode="exclude").select("user_id", F.array_sort(F.map_keys("m")).alias("ks"))


@query(f"SELECT user_id, m['view'] AS \"view\", m['click'] AS click, m['none'] AS \"none\" FROM ({MAPS})")
def proj_06_keys_as_struct(spark, d):
    out = project.keys(maps(spark, d), "m", ["view", "click", "none"], as_struct=True)
    return out.select("user_id", "m.view", "m.click", "m.none")


@query(f"SELECT user_id, m['click'] AS a, m['purchase'] AS b FROM ({MAPS})")
def proj_07_map_as_struct(spark, d):
    return project.keys(maps(spark, d), "m", ["click", "purchase"], as_struct=True).select("user_id", F.col("m.click").alias("a"), F.col("m.purchase").alias("b"))


@query(f"SELECT user_id, list_sort(map_keys(m)) AS ks, len(map_keys(m))::INT AS n FROM ({MAPS})")
def proj_08_merged_map(spark, d):
    wide = project.shred(maps(spark, d), "user_id", "m")
    return project.merge(wide, "user_id", "key", "value").select("user_id", F.array_sort(F.map_keys("m")).alias("ks"), F.size("m").alias("n"))


@query(f"SELECT user_id, list_sort(map_keys(m)) AS ks FROM ({MAPS})")
def proj_09_map_keys(spark, d):
    return maps(spark, d).select("user_id", F.array_sort(project.extract("m", "keys")).alias("ks"))


@query(f"SELECT user_id, list_sort(map_values(m)) AS vs FROM ({MAPS})")
def proj_10_map_values(spark, d):
    return maps(spark, d).select("user_id", F.array_sort(project.extract("m", "values")).alias("vs"))


@query(f"SELECT user_id, len(map_keys(m))::BIGINT AS n FROM ({MAPS}) UNION ALL SELECT -vec_id - 1, len(embedding)::BIGINT FROM embeddings")
def proj_11_sizes(spark, d):
    of_map = maps(spark, d).select("user_id", project.extract("m", "size").alias("n"))
    return of_map.unionAll(read(spark, d, "embeddings").select((-F.col("vec_id") - 1).alias("user_id"), project.extract("embedding", "size").alias("n")))


@query(f"SELECT user_id, list_sum(list_transform(list_filter(map_entries(m), lambda e: e.key IN ('click', 'purchase')), lambda e: e.value))::BIGINT AS n FROM ({MAPS})")
def proj_12_key_filter(spark, d):
    kept = maps(spark, d).select("user_id", project.extract("m", "filter", ["click", "purchase"]).alias("m"))
    return kept.select("user_id", F.when(F.size("m") > 0, F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))


@query("SELECT event_id, user_id AS x FROM events")
def proj_13_struct_field(spark, d):
    st = read(spark, d, "events").select("event_id", F.struct(F.col("user_id").alias("x"), F.col("props").alias("y")).alias("s"))
    return st.select("event_id", project.extract("s", "field", "x").alias("x"))


@query(f"SELECT user_id, list_sort(list_transform(map_values(m), lambda v: v * 2)) AS xs FROM ({MAPS})")
def proj_14_chained(spark, d):
    m = maps(spark, d).select("user_id", F.transform_values("m", lambda k, v: F.struct((v * 2).alias("x"), k.alias("y"))).alias("m"))
    return m.select("user_id", F.array_sort(project.chain("m", [("values", None), ("element_field", "x")])).alias("xs"))


@query("SELECT vec_id, embedding[1:4] AS head FROM embeddings")
def proj_15_subfield_slice(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 4).alias("head"))


@query("SELECT o_orderkey AS k, o_totalprice AS v FROM orders")
def proj_16_batch_projection(spark, d):
    from laminar.sources import batches

    packed = batches.serialize(read(spark, d, "orders"), rows=2000)
    return batches.project(packed, read(spark, d, "orders").schema, ["o_orderkey", "o_totalprice"], ["k", "v"])


@query("SELECT o_custkey, o_totalprice FROM orders")
def proj_18_key_omitted(spark, d):
    return project.omit_keys(read(spark, d, "orders"), ["o_orderkey"], ["o_custkey", "o_totalprice"])


# Filters.


def _filter(name: str, source: str, columns: str, predicate, sql: str) -> None:
    def run(spark, d):
        return read(spark, d, source).where(predicate()).select(*columns.split(", "))

    run.__name__ = name
    query(f"SELECT {columns} FROM {source} WHERE {sql}")(run)


_filter("filt_01_bigint_range", "lineitem", "l_orderkey, l_partkey", lambda: P.bigint_range("l_partkey", 100, 400), "l_partkey BETWEEN 100 AND 400")
_filter("filt_01_bigint_equal", "lineitem", "l_orderkey, l_quantity", lambda: P.bigint_range("l_orderkey", 77, 77), "l_orderkey = 77")
_filter("filt_02_double_open", "lineitem", "l_orderkey, l_extendedprice", lambda: P.double_range("l_extendedprice", 5000, 9000, lower_open=True, upper_open=True), "l_extendedprice > 5000 AND l_extendedprice < 9000")
_filter("filt_02_double_unbounded", "orders", "o_orderkey", lambda: P.double_range("o_totalprice", 200000, None), "o_totalprice >= 200000")
_filter("filt_03_bytes_range", "part", "p_partkey, p_brand", lambda: P.bytes_range("p_brand", "Brand#2", "Brand#4", upper_open=True), "p_brand >= 'Brand#2' AND p_brand < 'Brand#4'")
_filter("filt_04_bytes_values", "customer", "c_custkey, c_mktsegment", lambda: P.bytes_values("c_mktsegment", ["BUILDING", "MACHINERY"]), "c_mktsegment IN ('BUILDING', 'MACHINERY')")
_filter("filt_05_bool", "orders", "o_orderkey", lambda: P.bool_value(F.col("o_orderstatus") == "F", True), "o_orderstatus = 'F'")
_filter("filt_06_timestamp", "events", "event_id, ts", lambda: P.timestamp_range("ts", "2024-01-05", "2024-01-10"), "ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'")
_filter("filt_07_multi_range", "orders", "o_orderkey, o_orderdate", lambda: P.multi_range("o_orderdate", [("1995-01-01", "1995-03-31"), ("1997-06-01", "1997-06-30")]), "o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31' OR o_orderdate BETWEEN TIMESTAMP '1997-06-01' AND TIMESTAMP '1997-06-30'")
_filter("filt_08_is_null", "part", "p_partkey", lambda: P.is_null(F.nullif(F.col("p_size") % 7, F.lit(3))), "nullif(p_size % 7, 3) IS NULL")
_filter("filt_09_is_not_null", "part", "p_partkey", lambda: P.is_not_null(F.nullif(F.col("p_size") % 7, F.lit(3))), "nullif(p_size % 7, 3) IS NOT NULL")
_filter("filt_10_null_allowed", "part", "p_partkey, p_size", lambda: P.or_null(P.bigint_range(F.nullif(F.col("p_size"), F.lit(9)), 20, 30), F.nullif(F.col("p_size"), F.lit(9))), "nullif(p_size, 9) BETWEEN 20 AND 30 OR nullif(p_size, 9) IS NULL")
_filter("filt_11_conjunction", "lineitem", "l_orderkey, l_tax", lambda: P.conjunction([P.bigint_range("l_suppkey", 10, 60), P.double_range("l_tax", 0.02, 0.04), P.bytes_values("l_returnflag", ["A", "R"])]), "l_suppkey BETWEEN 10 AND 60 AND l_tax BETWEEN 0.02 AND 0.04 AND l_returnflag IN ('A', 'R')")


@query("SELECT event_id, event_type FROM events WHERE user_id > 20 AND event_type = 'view'")
def filt_12_struct(spark, d):
    st = read(spark, d, "events").select("event_id", F.struct("user_id", "event_type").alias("s"))
    return st.where(P.bigint_range("s.user_id", 21, None) & P.bytes_values("s.event_type", ["view"])).select("event_id", "s.event_type")


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id % 3 <> 0 GROUP BY user_id")
def filt_13_complex_not_null(spark, d):
    m = maps(spark, d).withColumn("m", F.when(F.col("user_id") % 3 != 0, F.col("m")))
    return m.where(P.is_not_null("m")).select("user_id", F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment LIKE '%I%')")
def filt_14_dictionary(spark, d):
    return P.by_dictionary(read(spark, d, "customer"), "c_mktsegment", F.col("c_mktsegment").contains("I")).select("c_custkey")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING' AND c_custkey BETWEEN 100 AND 900 AND c_acctbal > 0")
def filt_15_bounds(spark, d):
    found = P.to_bounds(
        ["c_nationkey", "c_mktsegment", "c_custkey"], [True, True, True],
        {"c_nationkey": P.Range(7, 7), "c_mktsegment": P.Values(["BUILDING"]), "c_custkey": P.Range(100, 900), "c_acctbal": P.Range(0, None, lower_open=True)},
    )
    return read(spark, d, "customer").where(found.condition() & found.rest()).select("c_custkey", "c_acctbal")


# Scalar functions.


@query("SELECT event_id, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS z, v FROM (SELECT event_id, (user_id - 75) * 3 AS v FROM events)")
def fn_01_zigzag(spark, d):
    rows = read(spark, d, "events").select("event_id", ((F.col("user_id") - 75) * 3).alias("v"))
    z = rows.withColumn("z", scalar.zigzag("v"))
    return z.select("event_id", "z", scalar.unzigzag("z").alias("v"))


@query("SELECT l_orderkey, l_partkey, greatest(1, ceil(length(bin(l_partkey * 1000)) / 7.0))::INT AS n FROM lineitem")
def fn_02_varint_size(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_partkey", scalar.varint_size(F.col("l_partkey") * 1000).alias("n"))


@query("SELECT o_orderkey, length(bin(o_custkey))::INT AS bits FROM orders")
def fn_03_bits(spark, d):
    return read(spark, d, "orders").select("o_orderkey", scalar.bits("o_custkey").alias("bits"))


@query("SELECT o_orderkey // 8 AS word, sum((o_orderkey % 13) << ((o_orderkey % 8) * 4)::INT)::BIGINT AS packed, count(*) AS n FROM orders GROUP BY 1")
def fn_04_pack(spark, d):
    return scalar.pack(read(spark, d, "orders").select(F.col("o_orderkey").alias("i"), (F.col("o_orderkey") % 13).alias("v")), 4, 8)


# Nanoseconds of the size of present-day ones, before and after the epoch, beyond what a double holds.
@query("SELECT event_id, (t - n) // 1000 AS micros, n AS nanos FROM (SELECT event_id, t, ((t % 1000) + 1000) % 1000 AS n FROM (SELECT event_id, (user_id - 70) * 27764557984720173 + event_id AS t FROM events))")
def fn_05_timestamp_split(spark, d):
    t = (F.col("user_id") - 70).cast("decimal(20,0)") * F.lit(Decimal(27764557984720173)) + F.col("event_id")
    micros, nanos = scalar.split_nanos(t, wide=True)
    return read(spark, d, "events").select("event_id", micros.alias("micros"), nanos.alias("nanos"))


# Each user's map against itself turned round, against one with a value changed for even users, and against null.
@query("SELECT a.user_id, true AS same, user_id % 2 <> 0 AS changed, false AS missing, len(map_keys(m)) > 1 AS several FROM (" + MAPS + ") a")
def fn_09_map_equality(spark, d):
    m = maps(spark, d)
    entries = F.reverse(F.map_entries("m"))
    step = F.when(F.col("user_id") % 2 == 0, 1).otherwise(0)
    other = F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), (e["value"] + F.when(i == 0, step).otherwise(0)).alias("value")))
    turned = m.withColumn("r", F.map_from_entries(entries)).withColumn("o", F.map_from_entries(other)).withColumn("n", F.when(F.col("user_id") < 0, F.col("m")))
    return turned.select("user_id", scalar.same_map("m", "r").alias("same"), scalar.same_map("m", "o").alias("changed"), scalar.same_map("m", "n").alias("missing"), (F.size("m") > 1).alias("several"))


@query("SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS scaled, CAST(round(p_retailprice * 100) AS BIGINT) / 100.0::DOUBLE = p_retailprice AS exact FROM part")
def fn_11_decimal_scale(spark, d):
    scaled, exact = scalar.decimal_scale("p_retailprice", 2)
    return read(spark, d, "part").select("p_partkey", scaled.alias("scaled"), exact.alias("exact"))

