"""Lookups, joins, row ranges, indexes and introspection: each query with the SQL that gives its rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from laminar.operators import codecs, dedup, lookup, ranges, scan
from laminar.plans.dsl import run as dsl
from laminar.plans.tables import CHUNK, STRIPES, numbered, read, table
from laminar.sources import writer
from laminar.sources.shared import scratch
from laminar.table import ColTable

L, O, E = numbered("lineitem"), numbered("orders"), numbered("events")
Q: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


# Requests: part keys for lineitem's orders, and ranges of order keys, made from the customers.

POINTS = "SELECT c_custkey AS request_id, c_custkey * 3 AS key FROM customer"
RANGES = "SELECT c_custkey AS request_id, c_custkey * 20 AS lo, c_custkey * 20 + c_nationkey AS hi FROM customer"


def points(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), (F.col("c_custkey") * 3).alias("key"))


def spans(spark, d):
    c = read(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("request_id"), (F.col("c_custkey") * 20).alias("lo"), (F.col("c_custkey") * 20 + F.col("c_nationkey")).alias("hi"))


@query(f"SELECT r.request_id, t.row_id, t.l_partkey, t.l_quantity FROM ({POINTS}) r JOIN {L} t ON t.l_orderkey = r.key")
def join_01_index_lookup(spark, d):
    return lookup.batch_lookup(table(spark, d, "lineitem"), points(spark, d), "l_orderkey", ["l_partkey", "l_quantity"])


@query(f"SELECT r.request_id, t.row_id, t.o_orderkey, t.o_totalprice FROM ({RANGES}) r JOIN {O} t ON t.o_orderkey >= r.lo AND t.o_orderkey < r.hi")
def join_02_index_range(spark, d):
    return lookup.range_rows(table(spark, d, "orders"), spans(spark, d), "o_orderkey", ["o_orderkey", "o_totalprice"])


@query(f"SELECT request_id, row_id, l_partkey FROM (SELECT r.request_id, t.row_id, t.l_partkey, row_number() OVER (PARTITION BY r.request_id ORDER BY t.row_id) AS n FROM ({POINTS}) r JOIN {L} t ON t.l_orderkey = r.key) WHERE n <= 2")
def join_03_capped(spark, d):
    return lookup.batch_lookup(table(spark, d, "lineitem"), points(spark, d), "l_orderkey", ["l_partkey"], max_rows_per_request=2)


@query(f"SELECT request_id, row_id, l_partkey FROM (SELECT r.request_id, t.row_id, t.l_partkey, row_number() OVER (PARTITION BY r.request_id ORDER BY t.row_id) AS n FROM ({POINTS}) r JOIN {L} t ON t.l_orderkey = r.key WHERE t.l_quantity > 20) WHERE n <= 2")
def join_04_residual_filter(spark, d):
    return lookup.batch_lookup(table(spark, d, "lineitem"), points(spark, d), "l_orderkey", ["l_partkey"], F.col("l_quantity") > 20, 2)


_RANKED = f"SELECT r.request_id, t.row_id, t.o_orderkey, t.o_totalprice, row_number() OVER (PARTITION BY r.request_id ORDER BY t.row_id) AS n FROM ({RANGES}) r JOIN {O} t ON t.o_orderkey >= r.lo AND t.o_orderkey < r.hi"


@query(f"SELECT request_id, row_id, o_totalprice FROM ({_RANKED}) WHERE n <= 4")
def join_05_projected_rows(spark, d):
    return lookup.project_lookup(table(spark, d, "orders"), spans(spark, d), "o_orderkey", ["o_totalprice"], 4)[0]


@query(f"SELECT request_id, o_orderkey AS resume_key FROM ({_RANKED}) WHERE n = 5")
def join_05_resume_keys(spark, d):
    return lookup.project_lookup(table(spark, d, "orders"), spans(spark, d), "o_orderkey", ["o_totalprice"], 4)[1]


@query(
    f"WITH h AS (SELECT r.request_id, t.row_id, t.stripe_id FROM ({POINTS}) r JOIN {L} t ON t.l_orderkey = r.key), s AS (SELECT stripe_id, count(*) AS c FROM h GROUP BY 1), "
    "b AS (SELECT stripe_id, coalesce(sum(c) OVER (ORDER BY stripe_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s) SELECT request_id, row_id FROM h JOIN b USING (stripe_id) WHERE b < 700"
)
def join_05_soft_limit(spark, d):
    t = table(spark, d, "lineitem")
    return lookup.soft_limit(t, lookup.batch_lookup(t, points(spark, d), "l_orderkey", []), 700)


@query(
    f"WITH h AS (SELECT r.request_id, t.row_id, t.stripe_id, t.l_partkey, t.l_returnflag FROM ({POINTS}) r JOIN {L} t ON t.l_orderkey = r.key), s AS (SELECT stripe_id, sum(8 + octet_length(encode(l_returnflag))) AS c FROM h GROUP BY 1), "
    "b AS (SELECT stripe_id, coalesce(sum(c) OVER (ORDER BY stripe_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s) SELECT request_id, row_id, l_partkey, l_returnflag FROM h JOIN b USING (stripe_id) WHERE b < 9000"
)
def join_05_soft_bytes(spark, d):
    t = table(spark, d, "lineitem")
    return lookup.soft_limit(t, lookup.batch_lookup(t, points(spark, d), "l_orderkey", ["l_partkey", "l_returnflag"]), max_bytes=9000)


@query(f"SELECT request_id, key FROM ({POINTS}) WHERE key IN (SELECT l_orderkey FROM lineitem)")
def join_06_hits(spark, d):
    return lookup.hits(points(spark, d), read(spark, d, "lineitem"), "l_orderkey").select("request_id", "key")


@query(f"SELECT request_id, key FROM ({POINTS}) WHERE key NOT IN (SELECT l_orderkey FROM lineitem)")
def join_06_misses(spark, d):
    return lookup.misses(points(spark, d), read(spark, d, "lineitem"), "l_orderkey").select("request_id", "key")


@query(f"SELECT stripe_id, row_id, event_type AS v FROM {E}")
def join_07_dictionary_decode(spark, d):
    letters, codes = codecs.dictionary(codecs.column(table(spark, d, "events").df, "event_type"))
    return codecs.dictionary_decode(letters, codes)


# Row ranges: each user's events as row numbers.

_SPANS = f"SELECT user_id AS g, row_id - row_id % 7 AS start_row, row_id + 5 + user_id % 4 AS end_row FROM {E}"


def user_spans(spark, d):
    t = table(spark, d, "events").df
    return t.select(F.col("user_id").alias("g"), (F.col("row_id") - F.col("row_id") % 7).alias("start_row"), (F.col("row_id") + 5 + F.col("user_id") % 4).alias("end_row"))


@query(f"SELECT g, greatest(start_row, 1000) AS start_row, least(end_row, 6000) AS end_row FROM ({_SPANS}) WHERE greatest(start_row, 1000) < least(end_row, 6000)")
def set_01_intersect(spark, d):
    return ranges.intersect(user_spans(spark, d), 1000, 6000)


@query(
    f"WITH r AS (SELECT g, start_row, end_row, max(end_row) OVER (PARTITION BY g ORDER BY start_row, end_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ({_SPANS})), "
    "m AS (SELECT *, sum(CASE WHEN p IS NULL OR start_row > p THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY start_row, end_row ROWS UNBOUNDED PRECEDING) AS k FROM r) SELECT g, min(start_row) AS start_row, max(end_row) AS end_row FROM m GROUP BY g, k"
)
def set_02_union(spark, d):
    return ranges.union(user_spans(spark, d), "g")


@query(
    f"WITH r AS ({_SPANS}), b AS (SELECT DISTINCT g, x FROM (SELECT g, start_row AS x FROM r UNION ALL SELECT g, end_row FROM r)), p AS (SELECT g, x AS start_row, lead(x) OVER (PARTITION BY g ORDER BY x) AS end_row FROM b), "
    "c AS (SELECT p.g, p.start_row, p.end_row, count(*) AS covering FROM p JOIN r ON r.g = p.g AND r.start_row <= p.start_row AND r.end_row >= p.end_row WHERE p.end_row IS NOT NULL GROUP BY ALL) SELECT * FROM c"
)
def set_03_split(spark, d):
    return ranges.split(user_spans(spark, d), "g")


@query(f"WITH t AS (SELECT user_id, row_id, row_id - row_number() OVER (PARTITION BY user_id ORDER BY row_id) AS k FROM {E}) SELECT user_id, min(row_id) AS start_row, max(row_id) + 1 AS end_row FROM t GROUP BY user_id, k")
def set_islands(spark, d):
    return ranges.islands(table(spark, d, "events").df.select("user_id", "row_id"), "user_id")


@query("SELECT user_id, list_sort(list_filter(t, lambda x: x IN ('click', 'view'))) AS kept, list_sort(list_filter(t, lambda x: x NOT IN ('click', 'view'))) AS rest FROM (SELECT user_id, list(DISTINCT event_type) AS t FROM events GROUP BY user_id)")
def set_04_key_sets(spark, d):
    keys = F.array(F.lit("click"), F.lit("view"))
    got = read(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    return got.select("user_id", F.array_sort(F.array_intersect("t", keys)).alias("kept"), F.array_sort(F.array_except("t", keys)).alias("rest"))


# Indexes.


@query(f"SELECT stripe_id AS part, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, min(row_id) AS start_row, count(*) AS rows FROM {O} GROUP BY stripe_id")
def idx_01_cluster_bounds(spark, d):
    return lookup.bounds(table(spark, d, "orders"), "o_orderkey")


@query(f"SELECT r.request_id, min(t.row_id) AS start_row, max(t.row_id) + 1 AS end_row FROM ({POINTS}) r JOIN {L} t ON t.l_orderkey = r.key GROUP BY r.request_id")
def idx_02_point_ranges(spark, d):
    return lookup.point_ranges(table(spark, d, "lineitem"), points(spark, d), "l_orderkey")


@query(f"SELECT r.request_id, min(t.row_id) AS start_row, max(t.row_id) + 1 AS end_row FROM ({RANGES}) r JOIN {O} t ON t.o_orderkey >= r.lo AND t.o_orderkey < r.hi GROUP BY r.request_id")
def idx_03_range_ranges(spark, d):
    rows = lookup.range_rows(table(spark, d, "orders"), spans(spark, d), "o_orderkey", [])
    return rows.groupBy("request_id").agg(F.min("row_id").alias("start_row"), (F.max("row_id") + 1).alias("end_row"))


@query(f"WITH p AS (SELECT chunk_id AS part, min(o_orderkey) AS a, max(o_orderkey) AS b FROM {O} GROUP BY 1) SELECT r.request_id, p.part FROM ({RANGES}) r JOIN p ON p.a < r.hi AND p.b >= r.lo")
def idx_04_pruning(spark, d):
    return lookup.pruned(table(spark, d, "orders"), spans(spark, d), "o_orderkey")


# Ranges that are open, empty, beyond the table's ends, or over many equal keys.
_ODD = "SELECT * FROM (VALUES (1, NULL::BIGINT, 40::BIGINT), (2, 14900, NULL), (3, 70, 70), (4, 90, 80), (5, -50, 3), (6, 100000000, 100000005), (7, -9, -1), (8, 500, 501), (9, 1, 2)) t(request_id, lo, hi)"


@query(f"SELECT r.request_id, t.row_id, t.l_orderkey FROM ({_ODD}) r JOIN {L} t ON (r.lo IS NULL OR t.l_orderkey >= r.lo) AND (r.hi IS NULL OR t.l_orderkey < r.hi)")
def join_02_odd_ranges(spark, d):
    asked = spark.createDataFrame([(1, None, 40), (2, 14900, None), (3, 70, 70), (4, 90, 80), (5, -50, 3), (6, 100000000, 100000005), (7, -9, -1), (8, 500, 501), (9, 1, 2)], "request_id int, lo long, hi long")
    return lookup.range_rows(table(spark, d, "lineitem"), asked, "l_orderkey", ["l_orderkey"])


@query(f"SELECT row_id, o_orderkey AS key FROM {O} WHERE row_id = 7777")
def idx_05_key_at_row(spark, d):
    return lookup.key_at(table(spark, d, "orders"), 7777, "o_orderkey")


def _hash_index(spark, d):
    t = table(spark, d, "orders")
    if "hash" not in _BUILT.setdefault(id(t), {"table": t}):
        _BUILT[id(t)]["hash"] = lookup.HashIndex(t, "o_custkey", 32)
    return _BUILT[id(t)]["hash"]


def _sorted_index(spark, d):
    t = table(spark, d, "orders")
    if "sorted" not in _BUILT.setdefault(id(t), {"table": t}):
        _BUILT[id(t)]["sorted"] = lookup.SortedIndex(t, "o_custkey")
    return _BUILT[id(t)]["sorted"]


_BUILT: dict[int, dict] = {}


@query(f"SELECT r.request_id, t.row_id, t.o_custkey, t.o_totalprice FROM ({POINTS}) r JOIN {O} t ON t.o_custkey = r.key")
def idx_06_hash_index(spark, d):
    """Rows through the index: bucket, entry, row number, row."""
    return _hash_index(spark, d).rows(points(spark, d), ["o_custkey", "o_totalprice"])


@query("SELECT o_custkey AS key, count(*) AS rows, 1 AS buckets FROM orders GROUP BY 1")
def idx_06_hash_entries(spark, d):
    """Each key's entries, all in one bucket."""
    return _hash_index(spark, d).entries.groupBy("key").agg(F.count("*").alias("rows"), F.count_distinct("bucket").cast("int").alias("buckets"))


@query(
    f"WITH r AS ({POINTS}), b AS (SELECT min(o_custkey) AS a, max(o_custkey) AS z FROM orders), m AS (SELECT r.key, r.key < a OR r.key > z AS out, c FROM r, b LEFT JOIN (SELECT o_custkey, count(*) AS c FROM orders GROUP BY 1) o ON o.o_custkey = r.key) "
    "SELECT count(*) AS lookups, count(*) FILTER (out) AS range_skips, count(*) FILTER (NOT out AND c IS NULL) AS in_vain, coalesce(sum(c), 0)::BIGINT AS matched, true AS mostly_skipped FROM m"
)
def idx_08_index_counters(spark, d):
    """Keys that are not there are passed over by the ends or, nearly all of the others, by the filter."""
    c = _hash_index(spark, d).counters(points(spark, d))
    vain = F.col("filter_skips") + F.col("misses")
    return c.select("lookups", "range_skips", vain.alias("in_vain"), "matched", (F.col("misses") * 10 <= vain).alias("mostly_skipped"))


@query(f"SELECT o_custkey, row_id FROM {O} WHERE o_custkey >= 100 AND o_custkey < 200")
def idx_07_secondary_range(spark, d):
    return scan.secondary(table(spark, d, "orders"), "o_custkey").where("o_custkey >= 100 AND o_custkey < 200").select("o_custkey", "row_id")


@query(f"SELECT r.request_id, t.row_id, t.o_orderkey, t.o_custkey FROM ({RANGES}) r JOIN {O} t ON t.o_custkey >= r.lo AND t.o_custkey < r.hi")
def idx_07_sorted_ranges(spark, d):
    """Ranges of a column that the table is not sorted by, through the index."""
    index = _sorted_index(spark, d)
    return index.rows(index.ranges(spans(spark, d)), ["o_orderkey", "o_custkey"])


@query(f"SELECT r.request_id, t.row_id FROM ({POINTS}) r JOIN {O} t ON t.o_custkey = r.key")
def idx_07_sorted_points(spark, d):
    return _sorted_index(spark, d).points(points(spark, d))


@query(
    f"WITH r AS ({POINTS}), b AS (SELECT min(o_orderkey) AS a, max(o_orderkey) AS z FROM orders), m AS (SELECT r.key, r.key < a OR r.key > z AS out, c FROM r, b LEFT JOIN (SELECT o_orderkey, count(*) AS c FROM orders GROUP BY 1) o ON o.o_orderkey = r.key) "
    "SELECT count(*) AS lookups, count(*) FILTER (out) AS range_skips, count(*) FILTER (NOT out AND c IS NULL) AS misses, coalesce(sum(c), 0)::BIGINT AS matched FROM m"
)
def idx_08_counters(spark, d):
    return lookup.lookup_counters(table(spark, d, "orders"), points(spark, d), "o_orderkey")


@query(f"SELECT o_orderkey AS row_id, o_orderkey // {STRIPES['lineitem']} AS stripe_id, o_orderkey // {CHUNK} AS chunk_id, o_orderkey % {CHUNK} AS row_in_chunk FROM orders WHERE o_orderkey >= 0 AND o_orderkey < (SELECT count(*) FROM lineitem)")
def idx_10_row_parts(spark, d):
    return lookup.row_parts(table(spark, d, "lineitem"), read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id")))


@query(f"SELECT stripe_id, count(*) AS n FROM {L} WHERE l_orderkey BETWEEN 2000 AND 9000 GROUP BY stripe_id")
def idx_12_scan_by_index(spark, d):
    return table(spark, d, "lineitem").df.where(F.col("l_orderkey").between(2000, 9000)).groupBy("stripe_id").agg(F.count("*").alias("n"))


# Introspection.


@query("SELECT * FROM (VALUES ('o_orderkey', 'long', 1), ('o_custkey', 'long', 2), ('o_orderstatus', 'string', 3), ('o_totalprice', 'double', 4), ('o_orderdate', 'timestamp_ntz', 5), ('o_orderpriority', 'string', 6)) t(\"column\", type, stream)")
def meta_02_describe(spark, d):
    return dsl(table(spark, d, "orders"), "DESCRIBE")


@query("SELECT * FROM (VALUES (0, 0, '', 'root', 'row'), (1, 1, 'o_orderkey', 'o_orderkey', 'long'), (2, 1, 'o_custkey', 'o_custkey', 'long'), (3, 1, 'o_orderstatus', 'o_orderstatus', 'string'), (4, 1, 'o_totalprice', 'o_totalprice', 'double'), (5, 1, 'o_orderdate', 'o_orderdate', 'timestamp_ntz'), (6, 1, 'o_orderpriority', 'o_orderpriority', 'string')) t(stream, depth, path, name, kind)")
def meta_03_schema(spark, d):
    return dsl(table(spark, d, "orders"), "SHOW SCHEMA")


_ORDER_SIZE = "8 + 8 + octet_length(encode(o_orderstatus)) + 8 + 12 + octet_length(encode(o_orderpriority))"


@query(f"SELECT 1 AS version, (SELECT ceil(count(*) / {STRIPES['orders']}.0)::BIGINT FROM orders) AS stripes, count(*) AS rows, sum({_ORDER_SIZE})::BIGINT AS raw_size, 'o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority' AS columns, NULL::VARCHAR AS checksum, NULL::DOUBLE AS rate, '' AS metadata FROM orders")
def meta_04_info(spark, d):
    return dsl(table(spark, d, "orders"), "show info;")


def _written(spark, d):
    """Orders, written with user metadata and opened again; once for each session and table."""
    t = table(spark, d, "orders")
    if "written" not in _BUILT.setdefault(id(t), {"table": t}):
        path = scratch(spark, "written")
        writer.write(t.df.select(*t.columns), path, ["o_orderkey"], writer.WriterOptions.parse({"stripe_rows": "4000", "chunk_rows": "512", "owner": "me", "purpose": "test"}))
        _BUILT[id(t)]["written"] = ColTable.open(spark, path)
    return _BUILT[id(t)]["written"]


@query(f"SELECT row_id, stripe_id, row_id // 512 AS chunk_id, o_orderkey, o_custkey, o_totalprice FROM {O}")
def scan_18_open(spark, d):
    """A written table, opened: rows, row numbers, stripes and chunks."""
    return _written(spark, d).df.select("row_id", "stripe_id", "chunk_id", "o_orderkey", "o_custkey", "o_totalprice")


@query(f"SELECT r.request_id, t.row_id, t.o_totalprice FROM ({RANGES}) r JOIN {O} t ON t.o_orderkey >= r.lo AND t.o_orderkey < r.hi")
def scan_18_open_lookup(spark, d):
    return lookup.range_rows(_written(spark, d), spans(spark, d), "o_orderkey", ["o_totalprice"])


@query("SELECT count(*) AS rows, 'owner=me, purpose=test' AS metadata, true AS packed, true AS sound FROM orders")
def meta_04_info_written(spark, d):
    """The checksum is that of the rows, and files take fewer bytes than they hold."""
    t = _written(spark, d)
    sound = writer.checksum(t.df.select(*t.columns)).first()["checksum"]
    return dsl(t, "SHOW INFO").select("rows", "metadata", (F.col("rate") > 1).alias("packed"), (F.col("checksum") == F.lit(sound)).alias("sound"))


@query("SELECT section, size > 0 AS filled FROM (SELECT unnest(['data', 'metadata', 'ranges', 'stats', 'stripes']) AS section, 1 AS size) UNION ALL SELECT 'stripe ' || s, true FROM (SELECT DISTINCT (row_number() OVER () - 1) // 4000 AS s FROM orders)")
def meta_12_layout_written(spark, d):
    return dsl(_written(spark, d), "SHOW FILE LAYOUT").select("section", (F.col("size") > 0).alias("filled"))


@query("SELECT true AS written, false AS changed")
def wr_21_verify(spark, d):
    """The checksum of what was written holds, and that of rows with one value changed does not."""
    t = _written(spark, d)
    changed = t.df.select(*t.columns).withColumn("o_custkey", F.when(F.col("o_orderkey") == 7, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    same = writer.checksum(changed).select((F.col("checksum") == F.lit(t.about["checksum"])).alias("changed"))
    return same.select(F.lit(writer.verify(spark, t.path)).alias("written"), "changed")


@query("SELECT (sum(" + _ORDER_SIZE + "))::BIGINT AS raw, true AS smaller FROM orders")
def agg_18_compression_rate(spark, d):
    rate = writer.compression_rate(spark, _written(spark, d).path)
    return rate.select("raw", (F.col("stored") < F.col("raw")).alias("smaller"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey > 3000 AND o_orderstatus = 'F'")
def scan_19_connector(spark, d):
    """The written table by its own format, with pushed filters."""
    from laminar.sources import connector

    connector.register(spark)
    path = _written(spark, d).path
    rows = spark.read.format("laminar").load(path if "://" in path else f"file://{path}")
    return rows.where("o_orderkey > 3000 AND o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderstatus")


@query(
    "SELECT 'c_custkey' AS \"column\", count(c_custkey) AS values, 0::BIGINT AS nulls, min(c_custkey) AS min_long, max(c_custkey) AS max_long, NULL::DOUBLE AS min_double, NULL::DOUBLE AS max_double, NULL::VARCHAR AS min_string, NULL::VARCHAR AS max_string, (8 * count(*))::BIGINT AS size FROM customer"
    " UNION ALL SELECT 'c_name', count(*), 0, NULL, NULL, NULL, NULL, min(c_name), max(c_name), sum(octet_length(encode(c_name)))::BIGINT FROM customer"
    " UNION ALL SELECT 'c_nationkey', count(*), 0, min(c_nationkey), max(c_nationkey), NULL, NULL, NULL, NULL, 4 * count(*) FROM customer"
    " UNION ALL SELECT 'c_acctbal', count(*), 0, NULL, NULL, min(c_acctbal), max(c_acctbal), NULL, NULL, 8 * count(*) FROM customer"
    " UNION ALL SELECT 'c_mktsegment', count(*), 0, NULL, NULL, NULL, NULL, min(c_mktsegment), max(c_mktsegment), sum(octet_length(encode(c_mktsegment)))::BIGINT FROM customer"
)
def meta_05_stats(spark, d):
    return dsl(table(spark, d, "customer"), "SHOW STATS").drop("type", "physical_size")


@query("SELECT * FROM (VALUES ('c_custkey', 'long', true), ('c_name', 'string', true), ('c_nationkey', 'integer', true), ('c_acctbal', 'double', true), ('c_mktsegment', 'string', true)) t(\"column\", type, sized)")
def meta_05_types(spark, d):
    """Types, and physical sizes that are there and no larger than a raw copy with its prefixes."""
    found = dsl(table(spark, d, "customer"), "SHOW STATS")
    return found.select("column", "type", ((F.col("physical_size") > 0) & (F.col("physical_size") <= F.col("size") + 4 * F.col("values") + 1000)).alias("sized"))


_STRIPED = f"SELECT stripe_id, sum({_ORDER_SIZE})::BIGINT AS size, count(*) AS rows FROM {O} GROUP BY 1"


@query(f"SELECT stripe_id, size, rows, coalesce(sum(size) OVER (ORDER BY stripe_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stripe_offset FROM ({_STRIPED})")
def meta_06_stripes(spark, d):
    return dsl(table(spark, d, "orders"), "SHOW STRIPES")


@query(
    "SELECT *, coalesce(sum(length) OVER (PARTITION BY stripe_id ORDER BY stream ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stream_offset FROM (SELECT stripe_id, s AS stream, n AS name, count(*) AS items, 0::BIGINT AS nulls, sum(b)::BIGINT AS length FROM ("
    f"SELECT stripe_id, unnest([1, 2, 3, 4, 5, 6]) AS s, unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS n, unnest([8, 8, octet_length(encode(o_orderstatus)), 8, 12, octet_length(encode(o_orderpriority))]) AS b FROM {O} WHERE stripe_id = 1) GROUP BY ALL)"
)
def meta_07_streams(spark, d):
    return dsl(table(spark, d, "orders"), "SHOW STREAMS STRIPE 1")


@query(f"SELECT row_id, o_orderstatus AS value FROM {O} WHERE stripe_id = 2")
def meta_11_content(spark, d):
    return dsl(table(spark, d, "orders"), "SHOW CONTENT 3 STRIPE 2")


@query(f"SELECT stripe_id // 4 AS group_id, count(*) AS stripes, sum(rows)::BIGINT AS rows, sum(size)::BIGINT AS size FROM ({_STRIPED}) GROUP BY 1")
def meta_13_stripe_groups(spark, d):
    return dsl(table(spark, d, "orders"), "SHOW STRIPE GROUPS")


@query(f"SELECT stripe_id, stripe_id // 4 AS group_id, rows FROM ({_STRIPED})")
def meta_13_stripes_metadata(spark, d):
    return dsl(table(spark, d, "orders"), "SHOW STRIPES METADATA")


@query(f"SELECT 'stripe ' || stripe_id AS section, coalesce(sum(size) OVER (ORDER BY stripe_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\", size FROM ({_STRIPED})")
def meta_12_layout(spark, d):
    return dsl(table(spark, d, "orders"), "SHOW FILE LAYOUT")


@query(f"SELECT chunk_id AS part, min(row_id) AS first_row, count(*) AS rows, min(o_orderkey)::VARCHAR AS first_key, max(o_orderkey)::VARCHAR AS last_key FROM {O} GROUP BY 1")
def meta_09_index(spark, d):
    return dsl(table(spark, d, "orders"), "SHOW INDEX")


@query(
    "SELECT unnest(['SELECT columns|* [FROM t] [LIMIT n] [OFFSET n] [STRIPE s]', 'DESCRIBE', 'SHOW SCHEMA', 'SHOW INFO', 'SHOW STATS', 'SHOW STRIPES', 'SHOW STREAMS [STRIPE s]', 'SHOW ENCODING [STRIPE s]', 'SHOW INDEX', "
    "'SHOW HISTOGRAM [TOP n] [STRIPE s]', 'SHOW CONTENT stream [STRIPE s]', 'SHOW FILE LAYOUT', 'SHOW STRIPES METADATA', 'SHOW STRIPE GROUPS', 'SHOW OPTIONAL SECTIONS', 'HELP', 'QUIT']) AS command"
)
def meta_14_help(spark, d):
    return dsl(table(spark, d, "orders"), "HELP")


# Values kept once.


@query(f"SELECT user_id, event_id, event_type, is_new, sum(is_new::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1 AS slot FROM (SELECT *, NOT coalesce(event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), false) AS is_new FROM events)")
def wr_15_array_dedup(spark, d):
    rows = read(spark, d, "events").select("user_id", "event_id", F.array("event_type").alias("a"))
    marked = dedup.consecutive(rows, "a", "user_id", "event_id")
    return marked.select("user_id", "event_id", F.col("a")[0].alias("event_type"), "is_new", "slot")


@query("SELECT user_id, event_id, NOT coalesce(k = lag(k) OVER (PARTITION BY user_id ORDER BY event_id), false) AS is_new FROM (SELECT user_id, event_id, event_type || '|' || (event_id % 2)::VARCHAR AS k FROM events)")
def wr_14_map_dedup(spark, d):
    e = F.col("event_id") % 2
    # The entries come in either order; equal maps are the same value all the same.
    a, b = F.struct(F.lit("t").alias("k"), F.col("event_type").alias("v")), F.struct(F.lit("p").alias("k"), e.cast("string").alias("v"))
    turned = F.when(F.col("event_id") % 3 == 0, F.map_from_entries(F.array(a, b))).otherwise(F.map_from_entries(F.array(b, a)))
    rows = read(spark, d, "events").select("user_id", "event_id", turned.alias("m"))
    return dedup.consecutive(rows, "m", "user_id", "event_id", is_map=True).select("user_id", "event_id", "is_new")


@query("SELECT user_id, count(*) AS values, count(*) FILTER (is_new) AS stored FROM (SELECT user_id, NOT coalesce(event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), false) AS is_new FROM events) GROUP BY user_id")
def agg_06_dedup_stats(spark, d):
    rows = read(spark, d, "events").select("user_id", "event_id", F.array("event_type").alias("a"))
    return dedup.dedup_stats(dedup.consecutive(rows, "a", "user_id", "event_id"), ["user_id"])


@query(f"SELECT stripe_id, unnest([['o_custkey', 'twin'], ['o_orderkey']]) AS columns FROM (SELECT DISTINCT stripe_id FROM {O})")
def wr_16_stream_dedup(spark, d):
    t = table(spark, d, "orders").df.withColumn("twin", F.col("o_custkey"))
    return dedup.stream_digests(t, ["o_custkey", "twin", "o_orderkey"], "stripe_id").select("stripe_id", "columns")
