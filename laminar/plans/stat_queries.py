"""Statistics, encodings and writers: each query with the SQL that gives its rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from laminar.functions import scalar
from laminar.operators import advisor, codecs, policies, scan, stats, symbols
from laminar.plans.dsl import run as dsl
from laminar.plans.tables import STRIPES, numbered, read, table
from laminar.sources import batches, writer
from laminar.table import ColTable

L, O, E, P = numbered("lineitem"), numbered("orders"), numbered("events"), numbered("part")
Q: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


def _stat(column: str, kind: str, source: str, size: str, by: str = "") -> str:
    cols = {k: "NULL::" + t for k, t in (("long", "BIGINT"), ("double", "DOUBLE"), ("string", "VARCHAR"))}
    ends = [f"{f}({column}) AS {f}_{k}" if k == kind else f"{cols[k]} AS {f}_{k}" for k in cols for f in ("min", "max")]
    group = f" GROUP BY {by}" if by else ""
    return f"SELECT {by + ', ' if by else ''}'{column}' AS \"column\", count({column}) AS values, count(*) - count({column}) AS nulls, {', '.join(ends)}, sum({size})::BIGINT AS size FROM {source}{group}"


_PART = " UNION ALL ".join([_stat("p_partkey", "long", "part", "8"), _stat("p_brand", "string", "part", "octet_length(encode(p_brand))"), _stat("p_retailprice", "double", "part", "8"), _stat("p_size", "long", "part", "4")])


@query(_PART)
def agg_01_column_stats(spark, d):
    return stats.column_stats(read(spark, d, "part"), columns=["p_partkey", "p_brand", "p_retailprice", "p_size"])


@query(" UNION ALL ".join([_stat("l_quantity", "double", L, "8", "stripe_id"), _stat("l_partkey", "long", L, "8", "stripe_id"), _stat("l_returnflag", "string", L, "octet_length(encode(l_returnflag))", "stripe_id")]))
def agg_02_stats_by_stripe(spark, d):
    return stats.column_stats(table(spark, d, "lineitem").df, ["stripe_id"], ["l_quantity", "l_partkey", "l_returnflag"])


@query("SELECT 'v' AS \"column\", count(v) AS values, count(*) - count(v) AS nulls, min(v) FILTER (NOT isnan(v)) AS lo, max(v) FILTER (NOT isnan(v)) AS hi FROM (SELECT CASE WHEN p_size = 7 THEN 'NaN'::DOUBLE WHEN p_size = 8 THEN NULL ELSE p_retailprice END AS v FROM part)")
def agg_03_double_nan(spark, d):
    v = F.when(F.col("p_size") == 7, F.lit(float("nan"))).when(F.col("p_size") != 8, F.col("p_retailprice"))
    out = stats.column_stats(read(spark, d, "part").select(v.alias("v")))
    return out.select("column", "values", "nulls", F.col("min_double").alias("lo"), F.col("max_double").alias("hi"))


@query(_stat("c_name", "string", "customer", "octet_length(encode(c_name))"))
def agg_04_strings(spark, d):
    return stats.column_stats(read(spark, d, "customer"), columns=["c_name"])


@query("SELECT 'b' AS \"column\", count(*) AS values, 0::BIGINT AS nulls, count(*) AS size FROM orders UNION ALL SELECT 'o_orderdate', count(*), 0, 12 * count(*) FROM orders")
def agg_05_counts_only(spark, d):
    rows = read(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("b"), "o_orderdate")
    return stats.column_stats(rows).select("column", "values", "nulls", "size")


@query(" UNION ALL ".join([_stat("l_quantity", "double", "lineitem", "8"), _stat("l_partkey", "long", "lineitem", "8"), _stat("l_returnflag", "string", "lineitem", "octet_length(encode(l_returnflag))")]))
def agg_07_merged(spark, d):
    return stats.merge_stats(stats.column_stats(table(spark, d, "lineitem").df, ["stripe_id"], ["l_quantity", "l_partkey", "l_returnflag"]))


@query(_PART)
def agg_08_vectors(spark, d):
    names = ["p_partkey", "p_brand", "p_retailprice", "p_size"]
    return stats.from_vectors(stats.as_vectors(stats.column_stats(read(spark, d, "part"), columns=names), names))


def _runs(value: str, source: str) -> str:
    return (
        f"SELECT stripe_id, run, any_value(v) AS v, count(*) AS length, min(row_id) AS first_row FROM (SELECT *, sum(n) OVER (PARTITION BY stripe_id ORDER BY row_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM "
        f"(SELECT stripe_id, row_id, {value} AS v, CASE WHEN {value} = lag({value}) OVER (PARTITION BY stripe_id ORDER BY row_id) THEN 0 ELSE 1 END AS n FROM {source})) GROUP BY stripe_id, run"
    )


@query(f"SELECT stripe_id, count(*) AS runs, min(length) AS min_run, max(length) AS max_run FROM ({_runs('l_returnflag', L)}) GROUP BY stripe_id")
def agg_09_run_stats(spark, d):
    return stats.run_stats(codecs.column(table(spark, d, "lineitem").df, "l_returnflag"))


@query("SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1")
def agg_10_unique_counts(spark, d):
    return stats.unique_counts(read(spark, d, "lineitem").select(F.col("l_quantity").alias("v")))


@query("SELECT min(octet_length(encode(p_name))) AS min_len, max(octet_length(encode(p_name))) AS max_len, sum(octet_length(encode(p_name)))::BIGINT AS total_len FROM part")
def agg_11_string_lengths(spark, d):
    return stats.lengths(read(spark, d, "part").select(F.col("p_name").alias("v")))


@query("SELECT greatest(0, ceil(length(bin(l_partkey - (SELECT min(l_partkey) FROM lineitem))) / 7.0) - 1)::INT AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def agg_12_varint_buckets(spark, d):
    return stats.varint_buckets(read(spark, d, "lineitem").select(F.col("l_partkey").alias("v")))


@query(f"SELECT row_id // 1024 AS block, count(*) AS \"count\", min(o_custkey) AS min, max(o_custkey) AS max FROM {O} GROUP BY 1")
def agg_13_blocks(spark, d):
    return stats.block_range(codecs.column(table(spark, d, "orders").df, "o_custkey"))


@query(f"SELECT sum(octet_length(encode(v)))::BIGINT AS run_bytes, (SELECT sum(octet_length(encode(l_returnflag)))::BIGINT FROM lineitem) AS bytes FROM ({_runs('l_returnflag', L)})")
def agg_14_run_bytes(spark, d):
    rows = codecs.column(table(spark, d, "lineitem").df, "l_returnflag")
    total = rows.agg(F.sum(F.octet_length("v")).alias("bytes"))
    return stats.runs(rows).agg(F.sum(F.octet_length("v")).alias("run_bytes")).crossJoin(total)  # two single rows


@query("WITH c AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1) SELECT min(v) AS v, max(n) AS n FROM c WHERE n = (SELECT max(n) FROM c)")
def agg_15_most_frequent(spark, d):
    return stats.most_frequent(read(spark, d, "lineitem").select(F.col("l_quantity").alias("v")))


# Batches of stripes, so that their number and rows follow from the table; the bytes are at least those of the numbers.
@query(f"SELECT count(*) AS batches, min(n) AS min_rows, max(n) AS max_rows, avg(n)::DOUBLE AS avg_rows, sum(n)::BIGINT AS total_rows, true AS fits FROM (SELECT stripe_id, b, count(*) AS n FROM (SELECT stripe_id, row_id % {STRIPES['orders']} // 700 AS b FROM {O}) GROUP BY ALL)")
def agg_17_batch_sizes(spark, d):
    t = table(spark, d, "orders")
    s = batches.sizes(batches.serialize_groups(t.df.select("stripe_id", "row_id", "o_orderkey", "o_totalprice"), "stripe_id", "row_id", 700))
    fits = (F.col("min_bytes") >= 16 * F.col("min_rows")) & (F.col("max_bytes") <= 64 * F.col("max_rows")) & (F.col("total_bytes") >= F.col("max_bytes"))
    return s.select("batches", "min_rows", "max_rows", "avg_rows", "total_rows", fits.alias("fits"))


# All keys that were added, and how many of as many that were not the filter lets through: about 1 % at ten bits a key.
@query("SELECT (SELECT count(*) FROM customer) AS added, 0::BIGINT AS missed, (SELECT count(*) FROM customer) AS others, true AS few, true AS sound")
def agg_19_bloom(spark, d):
    keys = read(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    n = keys.count()
    bits = writer.bloom_bits(n)
    held = writer.bloom(keys, "key", bits)
    probes = keys.unionByName(keys.select((-F.col("key") - 1).alias("key")))
    got = writer.may_hold(held, probes, "key", bits).agg(F.count_if(F.expr("key >= 0")).alias("added"), F.count_if(F.expr("key >= 0 AND NOT maybe")).alias("missed"), F.count_if(F.expr("key < 0")).alias("others"), F.count_if(F.expr("key < 0 AND maybe")).alias("let"))
    return got.select("added", "missed", "others", (F.col("let") * 20 < F.col("others")).alias("few"), (F.col("let") < F.col("others")).alias("sound"))


@query(f"SELECT chunk_id, count(*) AS rows, count(*) FILTER (user_id % 5 = 0) AS nulls FROM {E} GROUP BY chunk_id")
def agg_20_chunk_stats(spark, d):
    rows = table(spark, d, "events").df.withColumn("v", F.when(F.col("user_id") % 5 != 0, F.col("user_id")))
    return stats.chunk_stats(rows, "v")


# Codecs.


@query(_runs("l_returnflag", L))
def enc_01_rle(spark, d):
    return codecs.rle(codecs.column(table(spark, d, "lineitem").df, "l_returnflag"))


@query(f"SELECT stripe_id, row_id, l_linestatus AS v FROM {L}")
def enc_01_rle_decode(spark, d):
    return codecs.rle_decode(codecs.rle(codecs.column(table(spark, d, "lineitem").df, "l_linestatus")))


@query(f"SELECT stripe_id, event_type AS v, row_number() OVER (PARTITION BY stripe_id ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT stripe_id, event_type FROM {E})")
def enc_02_dictionary_alphabet(spark, d):
    return codecs.dictionary(codecs.column(table(spark, d, "events").df, "event_type"))[0]


@query(f"SELECT stripe_id, row_id, dense_rank() OVER (PARTITION BY stripe_id ORDER BY event_type) - 1 AS code FROM {E}")
def enc_02_dictionary_codes(spark, d):
    return codecs.dictionary(codecs.column(table(spark, d, "events").df, "event_type"))[1]


@query(f"SELECT stripe_id, min(o_custkey) AS base, length(bin(max(o_custkey) - min(o_custkey)))::INT AS bits, (ceil(length(bin(max(o_custkey) - min(o_custkey))) / 8.0) * 8)::INT AS width FROM {O} GROUP BY stripe_id")
def enc_03_fixed_width(spark, d):
    g = codecs.column(table(spark, d, "orders").df, "o_custkey").groupBy("stripe_id").agg(F.min("v").alias("base"), F.length(F.bin(F.max("v") - F.min("v"))).alias("bits"))
    return g.withColumn("width", (F.ceil(F.col("bits") / 8) * 8).cast("int"))


@query(f"SELECT stripe_id, row_id, l_partkey * 7919 - 100000 AS v FROM {L}")
def enc_03_fixed_width_decode(spark, d):
    rows = table(spark, d, "lineitem").df.select("stripe_id", "row_id", (F.col("l_partkey") * 7919 - 100000).alias("v"))
    return codecs.unpacked(codecs.fixed_width(rows))


_NULLS = f"SELECT stripe_id, row_id, nullif(p_size, 9)::BIGINT AS v FROM {P}"


def nulls(spark, d):
    return table(spark, d, "part").df.select("stripe_id", "row_id", F.nullif(F.col("p_size"), F.lit(9)).cast("long").alias("v"))


@query(f"SELECT stripe_id, row_id, coalesce(v, max(v) OVER (PARTITION BY stripe_id) + 1) AS v, max(v) OVER (PARTITION BY stripe_id) + 1 AS sentinel FROM ({_NULLS})")
def enc_04_sentinel(spark, d):
    return codecs.sentinel(nulls(spark, d))


@query(_NULLS)
def enc_04_sentinel_decode(spark, d):
    return codecs.sentinel_decode(codecs.sentinel(nulls(spark, d)))


@query(f"SELECT stripe_id, row_number() OVER (PARTITION BY stripe_id ORDER BY row_id) - 1 AS place, v FROM ({_NULLS}) WHERE v IS NOT NULL")
def enc_05_nullable(spark, d):
    return codecs.nullable(nulls(spark, d))[1]


@query(_NULLS)
def enc_05_nullable_decode(spark, d):
    return codecs.nullable_decode(*codecs.nullable(nulls(spark, d)))


@query(f"SELECT stripe_id, row_id, rare FROM (SELECT stripe_id, row_id, v, sum(v::INT) OVER (PARTITION BY stripe_id) * 2 < count(*) OVER (PARTITION BY stripe_id) AS rare FROM (SELECT stripe_id, row_id, o_orderstatus = 'F' AS v FROM {O})) WHERE v = rare")
def enc_06_sparse_bool(spark, d):
    return codecs.sparse_bool(table(spark, d, "orders").df.select("stripe_id", "row_id", (F.col("o_orderstatus") == "F").alias("v")))


@query(f"SELECT stripe_id, row_id, o_orderstatus = 'F' AS v FROM {O}")
def enc_06_sparse_bool_decode(spark, d):
    rows = table(spark, d, "orders").df.select("stripe_id", "row_id", (F.col("o_orderstatus") == "F").alias("v"))
    return codecs.sparse_bool_decode(codecs.sparse_bool_head(rows), codecs.sparse_bool(rows))


@query(f"SELECT stripe_id, row_id, row_id >= 4000 AND stripe_id % 2 = 0 AS v FROM {O}")
def enc_06_constant_groups_decode(spark, d):
    """Groups that are all false, all true, or both."""
    rows = table(spark, d, "orders").df.select("stripe_id", "row_id", ((F.col("row_id") >= 4000) & (F.col("stripe_id") % 2 == 0)).alias("v"))
    return codecs.sparse_bool_decode(codecs.sparse_bool_head(rows), codecs.sparse_bool(rows))


@query(f"SELECT stripe_id, row_id, l_partkey * l_partkey * 1000003 - 5 AS v FROM {L}")
def enc_07_varint_decode(spark, d):
    rows = table(spark, d, "lineitem").df.select("stripe_id", "row_id", (F.col("l_partkey") * F.col("l_partkey") * 1000003 - 5).alias("v"))
    return codecs.varints_decode(codecs.varints(rows))


@query(f"SELECT stripe_id, sum(greatest(1, ceil(length(bin(o_custkey - m)) / 7.0)))::BIGINT AS bytes FROM (SELECT stripe_id, o_custkey, min(o_custkey) OVER (PARTITION BY stripe_id) AS m FROM {O}) GROUP BY stripe_id")
def enc_07_varint_stream(spark, d):
    """The bytes that are written, not an estimate of them."""
    coded = codecs.varints(codecs.column(table(spark, d, "orders").df, "o_custkey"))
    return coded.groupBy("stripe_id").agg(F.sum(F.size("bytes")).cast("long").alias("bytes"))


@query(f"SELECT stripe_id, sum(greatest(1, ceil(length(bin(o_custkey - m)) / 7.0)))::BIGINT AS bytes FROM (SELECT stripe_id, o_custkey, min(o_custkey) OVER (PARTITION BY stripe_id) AS m FROM {O}) GROUP BY stripe_id")
def enc_07_varint(spark, d):
    from laminar.functions.scalar import varint_size

    rows = codecs.column(table(spark, d, "orders").df, "o_custkey")
    base = rows.groupBy("stripe_id").agg(F.min("v").alias("m"))
    return rows.join(base, "stripe_id").groupBy("stripe_id").agg(F.sum(varint_size(F.col("v") - F.col("m"))).cast("long").alias("bytes"))


_DELTA = f"SELECT stripe_id, row_id, p IS NULL OR v < p AS restated, CASE WHEN p IS NULL OR v < p THEN v ELSE v - p END AS value FROM (SELECT stripe_id, row_id, o_custkey AS v, lag(o_custkey) OVER (PARTITION BY stripe_id ORDER BY row_id) AS p FROM {O})"


@query(_DELTA)
def enc_08_delta(spark, d):
    return codecs.delta(codecs.column(table(spark, d, "orders").df, "o_custkey"))


@query(f"SELECT stripe_id, row_id, o_custkey AS v FROM {O}")
def win_03_delta_decode(spark, d):
    return codecs.delta_decode(codecs.delta(codecs.column(table(spark, d, "orders").df, "o_custkey")))


@query(f"SELECT stripe_id, count(DISTINCT l_linestatus) = 1 AS constant FROM {L} GROUP BY stripe_id")
def enc_09_constant(spark, d):
    facts = advisor.facts(table(spark, d, "lineitem").df, "l_linestatus")
    return facts.select("stripe_id", (F.col("ndv") == 1).alias("constant"))


@query(f"WITH c AS (SELECT stripe_id, event_type AS v, count(*) AS n FROM {E} GROUP BY ALL), t AS (SELECT stripe_id, max(n) AS n FROM c GROUP BY 1) SELECT c.stripe_id, min(c.v) AS common, max(c.n) AS n FROM c JOIN t ON c.stripe_id = t.stripe_id AND c.n = t.n GROUP BY c.stripe_id")
def enc_10_mainly_constant(spark, d):
    return codecs.mainly_constant(codecs.column(table(spark, d, "events").df, "event_type"))[0]


@query(f"SELECT stripe_id, row_id, event_type AS v FROM {E}")
def enc_10_mainly_constant_decode(spark, d):
    rows = codecs.column(table(spark, d, "events").df, "event_type")
    return codecs.mainly_constant_decode(*codecs.mainly_constant(rows), rows)


_TYPES = f"SELECT stripe_id, row_id, CASE WHEN row_id % 5 <> 0 THEN event_type END AS v FROM {E}"


def _types(spark, d):
    return table(spark, d, "events").df.select("stripe_id", "row_id", F.when(F.col("row_id") % 5 != 0, F.col("event_type")).alias("v"))


@query(_TYPES)
def enc_10_nulls_decode(spark, d):
    rows = _types(spark, d)
    return codecs.mainly_constant_decode(*codecs.mainly_constant(rows), rows)


@query(_TYPES)
def enc_02_nulls_decode(spark, d):
    return codecs.dictionary_decode(*codecs.dictionary(_types(spark, d)))


@query(f"SELECT stripe_id, row_id, p_name AS v FROM {P}")
def enc_11_prefix_decode(spark, d):
    return codecs.shared_prefix_decode(codecs.shared_prefix(codecs.column(table(spark, d, "part").df, "p_name")))


# A column in order within each stripe: keys as text of one width.
@query(f"SELECT stripe_id, min(row_id) AS row_id FROM {P} WHERE printf('key/%08d', p_partkey) >= 'key/00000700x' GROUP BY 1")
def enc_11_prefix_seek(spark, d):
    rows = table(spark, d, "part").df.select("stripe_id", "row_id", F.format_string("key/%08d", "p_partkey").alias("v"))
    return codecs.prefix_seek(codecs.shared_prefix(rows), "key/00000700x")


_PREFIX = f"SELECT stripe_id, row_id, v, CASE WHEN row_id % 16 <> 0 THEN coalesce(lag(v) OVER (PARTITION BY stripe_id ORDER BY row_id), '') ELSE '' END AS b FROM (SELECT stripe_id, row_id, p_name AS v FROM {P})"


@query(f"SELECT stripe_id, row_id, s AS shared, v[s + 1:] AS suffix FROM (SELECT *, len(list_filter(range(1, least(length(v), length(b)) + 1), lambda i: v[:i] = b[:i])) AS s FROM ({_PREFIX}))")
def win_05_shared_prefix(spark, d):
    return codecs.shared_prefix(codecs.column(table(spark, d, "part").df, "p_name"))


@query(f"SELECT stripe_id, row_id, CASE WHEN s / 100.0::DOUBLE = v THEN s END AS scaled, CASE WHEN s / 100.0::DOUBLE <> v THEN v END AS exception FROM (SELECT stripe_id, row_id, p_retailprice AS v, round_even(p_retailprice * 100, 0)::BIGINT AS s FROM {P})")
def enc_12_alp(spark, d):
    return codecs.alp(codecs.column(table(spark, d, "part").df, "p_retailprice"), 2)


@query(f"SELECT stripe_id, row_id, p_retailprice AS v FROM {P}")
def enc_12_alp_decode(spark, d):
    return codecs.alp_decode(codecs.alp(codecs.column(table(spark, d, "part").df, "p_retailprice"), 2), 2)


@query(f"SELECT stripe_id, row_id, CASE row_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE -1 END AS sign, row_id % 4 = 1 AS minus FROM {P}")
def enc_12_alp_zeros(spark, d):
    """-0.0 comes back as -0.0."""
    v = F.expr("CASE row_id % 4 WHEN 0 THEN 1.25D WHEN 1 THEN -0.0D WHEN 2 THEN 0.0D ELSE -1.5D END")
    rows = codecs.alp_decode(codecs.alp(table(spark, d, "part").df.select("stripe_id", "row_id", v.alias("v")), 2), 2)
    return rows.select("stripe_id", "row_id", F.signum("v").cast("int").alias("sign"), scalar.negative_zero("v").alias("minus"))


@query("SELECT min(e)::INT AS exponent FROM (SELECT e, bool_and(round_even(p_retailprice * 10::DOUBLE ** e, 0) / 10::DOUBLE ** e = p_retailprice) AS fits FROM part, range(6) t(e) GROUP BY e) WHERE fits")
def enc_12_alp_exponent(spark, d):
    """Prices have so many places that a power of ten makes all of them whole; the least such one takes the fewest bits."""
    return spark.createDataFrame([(codecs.alp_exponent(codecs.column(table(spark, d, "part").df, "p_retailprice")),)], "exponent int")


# One value of 37 is far above the others.
_FAR = f"SELECT stripe_id, row_id, l_partkey + CASE WHEN row_id % 37 = 0 THEN 4000000000 + row_id ELSE 0 END AS v FROM {L}"
_PATCH = (
    f"WITH r AS ({_FAR}), b AS (SELECT stripe_id, min(v) AS base, count(*) AS n FROM r GROUP BY 1), s AS (SELECT r.*, base, n, length(bin(v - base)) AS bits FROM r JOIN b USING (stripe_id)), "
    "k AS (SELECT stripe_id, base, n, greatest(1, ceil(bits / 7.0))::INT AS k, count(*) AS c FROM s GROUP BY ALL), a AS (SELECT *, sum(c) OVER (PARTITION BY stripe_id ORDER BY k) AS r FROM k), w AS (SELECT stripe_id, base, n, 7 * min(k) AS width FROM a WHERE r >= n * 0.9 GROUP BY ALL) "
)


def _far(spark, d):
    far = F.when(F.col("row_id") % 37 == 0, F.lit(4000000000) + F.col("row_id")).otherwise(0)
    return table(spark, d, "lineitem").df.select("stripe_id", "row_id", (F.col("l_partkey") + far).alias("v"))


@query(_PATCH + "SELECT stripe_id, base, n, width::INT AS width FROM w")
def enc_13_patched_width(spark, d):
    return codecs.patched(_far(spark, d))[0]


@query(_PATCH + "SELECT stripe_id, row_id, v FROM s JOIN w USING (stripe_id) WHERE bits > width")
def enc_13_patched_exceptions(spark, d):
    return codecs.patched(_far(spark, d))[1]


@query(_FAR)
def enc_13_patched_decode(spark, d):
    return codecs.patched_decode(*codecs.patched_packed(_far(spark, d)))


@query(
    f"SELECT stripe_id, base, width, ceil(n / 32.0)::BIGINT AS groups, (n // 32 * width + ceil(n % 32 * width / 32.0))::BIGINT AS words FROM (SELECT stripe_id, min(o_custkey) AS base, length(bin(max(o_custkey) - min(o_custkey)))::INT AS width, count(*) AS n FROM {O} GROUP BY 1)"
)
def enc_14_groups_of_32(spark, d):
    """One base and one width for the stream; groups of 32 values fill as many words as the width has bits."""
    packed = codecs.fixed_width(codecs.column(table(spark, d, "orders").df, "o_custkey"), 32)
    return packed.groupBy("stripe_id", "base", "width").agg(F.count("*").alias("groups"), F.sum(F.size("words")).cast("long").alias("words"))


@query(f"SELECT stripe_id, row_id, o_custkey AS v FROM {O}")
def enc_14_groups_decode(spark, d):
    return codecs.unpacked(codecs.fixed_width(codecs.column(table(spark, d, "orders").df, "o_custkey"), 32))


@query(f"SELECT stripe_id, row_id % {STRIPES['lineitem']} // 1024 AS frame, min(l_orderkey) AS base, CASE WHEN max(l_orderkey) = min(l_orderkey) THEN 0 ELSE length(bin(max(l_orderkey) - min(l_orderkey))) END AS width, count(*) AS n FROM {L} GROUP BY ALL")
def enc_15_blocks(spark, d):
    return codecs.blocks(codecs.column(table(spark, d, "lineitem").df, "l_orderkey")).select("stripe_id", "frame", "base", "width", "n")


@query(f"SELECT stripe_id, row_id, l_orderkey AS v FROM {L}")
def enc_15_blocks_decode(spark, d):
    return codecs.unpacked(codecs.blocks(codecs.column(table(spark, d, "lineitem").df, "l_orderkey")))


@query(f"SELECT frame, least(ceil(c * w / 8.0) + 7, c * 8)::BIGINT AS bytes FROM (SELECT row_id // 1024 AS frame, count(*) AS c, CASE WHEN max(o_custkey) = min(o_custkey) THEN 0 ELSE length(bin(max(o_custkey) - min(o_custkey))) END AS w FROM {O} GROUP BY 1)")
def enc_15_block_packing(spark, d):
    return codecs.block_packed_bytes(codecs.column(table(spark, d, "orders").df, "o_custkey"), 1024, 8)


@query(f"SELECT stripe_id, row_id, o_custkey & 15 AS part0, (o_custkey >> 4) & 63 AS part1, o_custkey >> 10 AS part2 FROM {O}")
def enc_16_bit_ranges(spark, d):
    return codecs.bit_ranges(codecs.column(table(spark, d, "orders").df, "o_custkey"), [0, 4, 10])


@query(f"SELECT stripe_id, row_id, o_custkey AS v FROM {O}")
def enc_16_bit_ranges_decode(spark, d):
    return codecs.bit_ranges_decode(codecs.bit_ranges(codecs.column(table(spark, d, "orders").df, "o_custkey"), [0, 4, 10]), [0, 4, 10])


@query(f"SELECT stripe_id, row_id, l_quantity AS v FROM {L}")
def enc_17_frequency_decode(spark, d):
    return codecs.frequency_decode(*codecs.frequency_codes(codecs.column(table(spark, d, "lineitem").df, "l_quantity"), [4, 16]))


@query("SELECT v, n, place, CASE WHEN place < 4 THEN 0 WHEN place < 20 THEN 1 ELSE 2 END AS tier FROM (SELECT l_quantity AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_quantity) - 1 AS place FROM lineitem GROUP BY 1)")
def enc_17_frequency_tiers(spark, d):
    return codecs.frequency_tiers(read(spark, d, "lineitem").select(F.col("l_quantity").alias("v")), [4, 16])


@query(f"SELECT stripe_id, row_id // 128 AS frame, row_id, min(o_custkey) OVER (PARTITION BY row_id // 128) AS base, o_custkey - min(o_custkey) OVER (PARTITION BY row_id // 128) AS \"offset\" FROM {O}")
def enc_18_frames(spark, d):
    return codecs.frames(codecs.column(table(spark, d, "orders").df, "o_custkey"), 128)


# The least bits of any code of whole bits a value: twice the two rarest are joined, as recursion in SQL over sorted counts.
@query(
    "WITH RECURSIVE c AS (SELECT list(n ORDER BY n) AS l FROM (SELECT count(*) AS n FROM events GROUP BY event_type)), "
    "h AS (SELECT l, 0::BIGINT AS bits FROM c UNION ALL SELECT list_sort(list_append(l[3:], l[1] + l[2])), bits + l[1] + l[2] FROM h WHERE len(l) > 1) "
    "SELECT (SELECT count(DISTINCT event_type) FROM events) AS n_values, (SELECT count(*) FROM events) AS n, max(bits)::BIGINT AS bits, true AS prefix_free FROM h"
)
def enc_20_huffman(spark, d):
    """The coded bits are the least there are, and no code begins another."""
    coded = codecs.huffman(read(spark, d, "events").select(F.col("event_type").alias("v")))
    total = coded.agg(F.count("*").alias("n_values"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("code_length")).alias("bits"), F.sort_array(F.collect_list("code")).alias("_c"))
    return total.withColumn("prefix_free", F.expr("forall(transform(slice(_c, 2, size(_c)), (x, i) -> startswith(x, _c[i])), x -> NOT x)")).drop("_c")


@query(f"SELECT stripe_id, row_id, event_type AS v FROM {E}")
def enc_20_huffman_decode(spark, d):
    rows = codecs.column(table(spark, d, "events").df, "event_type")
    codes = codecs.huffman(rows.select("v"))
    return codecs.huffman_decode(codecs.huffman_encode(rows, codes), codes)


@query(f"SELECT stripe_id, row_id, l_partkey AS v FROM {L}")
def enc_20_huffman_many_decode(spark, d):
    """As many values as need codes of the longest length, some of them cut to it."""
    rows = codecs.column(table(spark, d, "lineitem").df, "l_partkey")
    rows = rows.withColumn("v", F.col("v"))
    codes = codecs.huffman(rows.select("v"))
    return codecs.huffman_decode(codecs.huffman_encode(rows, codes), codes)


@query(f"SELECT stripe_id, row_id, o_orderkey * 3 AS v FROM {O}")
def enc_21_delta_blocks_decode(spark, d):
    rows = table(spark, d, "orders").df.select("stripe_id", "row_id", (F.col("o_orderkey") * 3).alias("v"))
    return codecs.delta_blocks_decode(codecs.delta_blocks_packed(rows, 1024))


@query(f"SELECT row_id // 1024 AS frame, arg_min(v, row_id) AS base, coalesce(max(d) FILTER (row_id % 1024 <> 0), 0) AS max_delta, coalesce(min(d) FILTER (row_id % 1024 <> 0) >= 0, true) AS sorted FROM (SELECT row_id, o_orderkey AS v, o_orderkey - lag(o_orderkey) OVER (ORDER BY row_id) AS d FROM {O}) GROUP BY 1")
def enc_21_delta_blocks(spark, d):
    return codecs.delta_blocks(codecs.column(table(spark, d, "orders").df, "o_orderkey"), 1024)


@query("SELECT row_number() OVER (ORDER BY c_mktsegment) - 1 AS code, c_mktsegment AS v FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def enc_22_shared_dictionary(spark, d):
    return codecs.alphabet(codecs.column(table(spark, d, "customer").df, "c_mktsegment"), by_group=False)


@query(f"SELECT row_id, l_partkey AS v FROM {L} WHERE row_id IN (SELECT c_custkey * 31 FROM customer)")
def enc_39_random_access(spark, d):
    """Values out of packed words, for rows asked for in a table."""
    t = table(spark, d, "lineitem")
    packed = codecs.fixed_width(codecs.column(t.df, "l_partkey"), 1000)  # stripes begin at whole frames
    return codecs.value_at(packed, read(spark, d, "customer").select((F.col("c_custkey") * 31).alias("row_id")), 1000)


@query(f"SELECT stripe_id, row_id, o_custkey AS v FROM {O} WHERE row_id >= 3000 AND row_id < 4500")
def enc_40_slice(spark, d):
    """A range of rows out of packed words, over the end of a stripe."""
    return codecs.slice_of(codecs.fixed_width(codecs.column(table(spark, d, "orders").df, "o_custkey")), 3000, 4500)


# Estimates and the choice of an encoding, as closed formulas in SQL too.


def _packed(n: str, span: str, w: int) -> str:
    return f"({8 + w} + ceil(ceil(length(bin(({span})::BIGINT)) / 8.0) * 8 * ({n}) / 8.0))"


def _sparse(n: str, k: str) -> str:
    return f"(7 + {_packed(f'({k}) + 1', n, 4)})"


def _numeric(column: str, source: str, w: int) -> str:
    facts = (
        f"WITH r AS (SELECT stripe_id, row_id, {column}::BIGINT AS v FROM {source}), c AS (SELECT stripe_id, v, count(*) AS c FROM r GROUP BY ALL), runs AS ({_runs(column, source)}), "
        "rs AS (SELECT stripe_id, count(*) AS runs, min(length) AS a, max(length) AS z FROM runs GROUP BY 1), "
        "f AS (SELECT stripe_id, sum(c)::BIGINT AS n, count(*) AS ndv, max(c) AS m, min(v) AS lo, max(v) - min(v) AS span FROM c GROUP BY 1), "
        "vb AS (SELECT c.stripe_id, sum(greatest(1, ceil(length(bin(v - lo)) / 7.0)) * c)::BIGINT AS vb FROM c JOIN f USING (stripe_id) GROUP BY 1), "
        "a AS (SELECT * FROM f JOIN rs USING (stripe_id) JOIN vb USING (stripe_id)), "
    )
    e = {
        "Constant": f"CASE WHEN ndv = 1 THEN {6 + w} END",
        "Trivial": f"7 + n * {w}",
        "FixedBitWidth": _packed("n", "span", w),
        "MainlyConstant": f"{14 + w} + {_packed('n - m', 'span', w)} + {_sparse('n', 'n - m')}",
        "Dictionary": f"{_packed('n', 'ndv - 1', 4)} + least(7 + ndv * {w}, {_packed('ndv', 'span', w)}) + 10",
        "RLE": f"10 + {_packed('runs', 'z - a', 4)} + {_packed('runs', 'span', w)}",
        "Varint": f"{6 + w} + vb",
    }
    places = list(advisor.READ_FACTORS)
    rows = " UNION ALL ".join(f"SELECT stripe_id, '{k}' AS encoding, ({v})::BIGINT AS size, {places.index(k)} AS place, {advisor.READ_FACTORS[k]} AS factor FROM a" for k, v in e.items())
    return f"{facts} est AS (SELECT * FROM ({rows}) WHERE size IS NOT NULL) "


def _strings(column: str, source: str) -> str:
    size = "octet_length(encode(v))"
    facts = (
        f"WITH r AS (SELECT stripe_id, row_id, {column} AS v FROM {source}), c AS (SELECT stripe_id, v, count(*) AS c FROM r GROUP BY ALL), runs AS ({_runs(column, source)}), "
        "rs AS (SELECT stripe_id, count(*) AS runs, min(length) AS a, max(length) AS z FROM runs GROUP BY 1), "
        f"f AS (SELECT stripe_id, sum(c)::BIGINT AS n, count(*) AS ndv, max(c) AS m, sum({size} * c)::BIGINT AS total, sum({size})::BIGINT AS uniq, min({size}) AS lo, max({size}) AS hi FROM c GROUP BY 1), "
        "t AS (SELECT c.stripe_id, min(v) AS top FROM c JOIN f ON c.stripe_id = f.stripe_id AND c.c = f.m GROUP BY 1), "
        f"o AS (SELECT c.stripe_id, min({size}) AS ro, max({size}) AS rh FROM c JOIN t ON c.stripe_id = t.stripe_id AND c.v <> t.top GROUP BY 1), "
        "a AS (SELECT f.*, rs.runs, rs.a, rs.z, octet_length(encode(top)) AS ml, coalesce(ro, 0) AS ro, coalesce(rh, 0) AS rh FROM f JOIN rs USING (stripe_id) JOIN t USING (stripe_id) LEFT JOIN o USING (stripe_id)), "
    )
    alphabet = f"(11 + uniq + {_packed('ndv', 'hi - lo', 4)})"
    e = {
        "Constant": "CASE WHEN ndv = 1 THEN hi + 10 END",
        "Trivial": f"11 + total + {_packed('n', 'hi - lo', 4)}",
        "MainlyConstant": f"18 + ml + 11 + uniq - ml + {_packed('ndv - 1', 'rh - ro', 4)} + {_sparse('n', 'n - m')}",
        "Dictionary": f"{_packed('n', 'ndv - 1', 4)} + {alphabet} + 10",
        "RLE": f"10 + {_packed('runs', 'z - a', 4)} + {_packed('runs', 'ndv - 1', 4)} + {alphabet} + 10",
    }
    places = list(advisor.READ_FACTORS)
    rows = " UNION ALL ".join(f"SELECT stripe_id, '{k}' AS encoding, ({v})::BIGINT AS size, {places.index(k)} AS place, {advisor.READ_FACTORS[k]} AS factor FROM a" for k, v in e.items())
    return f"{facts} est AS (SELECT * FROM ({rows}) WHERE size IS NOT NULL) "


_CHOSEN = "SELECT stripe_id, encoding, size FROM (SELECT *, row_number() OVER (PARTITION BY stripe_id ORDER BY size * factor, place) AS k FROM est) WHERE k = 1"


@query(_numeric("o_custkey", O, 8) + "SELECT stripe_id, encoding, size, place FROM est")
def enc_38_estimates_numeric(spark, d):
    return advisor.estimates(table(spark, d, "orders").df, "o_custkey")


# One and so many sixty-fourths: doubles whose bits are these whole numbers.
@query(_numeric("4607182418800017408 + o_custkey % 64 * 70368744177664", O, 8) + "SELECT stripe_id, encoding, size, place FROM est")
def enc_38_estimates_double(spark, d):
    rows = table(spark, d, "orders").df.withColumn("x", 1 + F.col("o_custkey") % 64 / F.lit(64.0))
    return advisor.estimates(rows, "x")


@query(_strings("o_orderpriority", O) + "SELECT stripe_id, encoding, size, place FROM est")
def enc_38_estimates_string(spark, d):
    return advisor.estimates(table(spark, d, "orders").df, "o_orderpriority")


@query(_numeric("l_linenumber", L, 4) + _CHOSEN)
def enc_30_choice_numeric(spark, d):
    return advisor.choose(advisor.estimates(table(spark, d, "lineitem").df, "l_linenumber"), ["stripe_id"])


@query(_strings("l_returnflag", L) + _CHOSEN)
def enc_30_choice_string(spark, d):
    return advisor.choose(advisor.estimates(table(spark, d, "lineitem").df, "l_returnflag"), ["stripe_id"])


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE, {i})" for i, (k, v) in enumerate(advisor.READ_FACTORS.items())) + ") t(encoding, factor, place)")
def enc_31_read_factors(spark, d):
    rows = [(k, v, i) for i, (k, v) in enumerate(advisor.parse_read_factors(";".join(f"{k}={v}" for k, v in advisor.READ_FACTORS.items())).items())]
    return spark.createDataFrame(rows, "encoding string, factor double, place int")


@query("SELECT o_orderkey, 10 * (o_orderkey % 12) <= 98 AS kept FROM orders")
def enc_41_compression(spark, d):
    return read(spark, d, "orders").select("o_orderkey", advisor.accepts_compression(F.lit(100), F.col("o_orderkey") % 12 * 10).alias("kept"))


@query(
    "SELECT encoding, count(*) AS instances, sum(size)::BIGINT AS bytes FROM (" + "SELECT * FROM (" + _numeric("o_custkey", O, 8) + _CHOSEN + ") UNION ALL SELECT * FROM (" + _strings("o_orderpriority", O) + _CHOSEN + ")) GROUP BY encoding"
)
def agg_16_histogram(spark, d):
    chosen = advisor.choose_all(table(spark, d, "orders").df, ["o_custkey", "o_orderpriority"])
    return chosen.groupBy("encoding").agg(F.count("*").alias("instances"), F.sum("size").alias("bytes"))


_ROOTS = (
    "SELECT 'o_custkey' AS \"column\", stripe_id, encoding, size FROM (" + _numeric("o_custkey", "(SELECT * FROM " + O + " WHERE stripe_id = 1)", 8) + _CHOSEN + ") UNION ALL "
    "SELECT 'o_orderpriority', stripe_id, encoding, size FROM (" + _strings("o_orderpriority", "(SELECT * FROM " + O + " WHERE stripe_id = 1)") + _CHOSEN + ")"
)


@query(_ROOTS)
def meta_08_encoding(spark, d):
    shown = dsl(table(spark, d, "orders"), "SHOW ENCODING STRIPE 1").where("depth = 0 AND column IN ('o_custkey', 'o_orderpriority')")
    return shown.select("column", "stripe_id", "encoding", "size")


@query(
    f"WITH r AS ({_ROOTS}), c AS (SELECT * FROM (VALUES ('Dictionary', 'indices', 'FixedBitWidth'), ('Dictionary', 'alphabet', 'Trivial'), ('RLE', 'lengths', 'FixedBitWidth'), ('RLE', 'values', 'FixedBitWidth'), ('MainlyConstant', 'common', 'SparseBool'), ('MainlyConstant', 'others', 'FixedBitWidth')) t(parent, name, encoding)) "
    "SELECT \"column\" || '/' || name AS path, c.encoding FROM r JOIN c ON r.encoding = c.parent"
)
def meta_08_streams(spark, d):
    """The streams in an encoding, one level down."""
    shown = dsl(table(spark, d, "orders"), "SHOW ENCODING STRIPE 1").where("depth = 1 AND (path LIKE 'o_custkey/%' OR path LIKE 'o_orderpriority/%')")
    return shown.select("path", "encoding")


@query(
    "SELECT encoding, count(*) AS instances, sum(size)::BIGINT AS bytes FROM (SELECT * FROM (" + _numeric("p_partkey", P, 8) + _CHOSEN + ") UNION ALL SELECT * FROM (" + _strings("p_brand", P) + _CHOSEN + ")) GROUP BY encoding ORDER BY bytes DESC, encoding LIMIT 1"
)
def meta_10_histogram(spark, d):
    t = table(spark, d, "part")
    two = ColTable.lay_out(t.df.select("p_partkey", "p_brand"), ["p_partkey"], t.stripe_rows, t.chunk_rows)
    return dsl(two, "SHOW HISTOGRAM TOP 1").select("encoding", "instances", "bytes")


def _one(rows: str, order: str = "size * factor, place", where: str = "true") -> str:
    """The choice of each stripe's first estimate by an order."""
    return f"SELECT 'o_custkey' AS \"column\", stripe_id, encoding, size FROM (SELECT *, row_number() OVER (PARTITION BY stripe_id ORDER BY {order}) AS k FROM ({rows} SELECT * FROM est) WHERE {where}) WHERE k = 1"


@query(_one(_numeric("o_custkey", O, 8), "size, place"))
def enc_34_learned_policy(spark, d):
    """A score that is the size alone."""
    return policies.learned(lambda encoding, size: size)(table(spark, d, "orders").df, ["o_custkey"])


@query(_one(_numeric("o_custkey", O, 8), where="encoding = 'Varint'"))
def enc_35_replayed_policy(spark, d):
    return policies.replayed('{"o_custkey": "Varint"}')(table(spark, d, "orders").df, ["o_custkey"])


@query(_one(_numeric("o_custkey", O, 8), "size * factor, place"))
def enc_36_remembered_policy(spark, d):
    """The second pick replays the first, which is the same for each stripe of this column."""
    memo: dict[str, str] = {}
    pick = policies.remembered(policies.cost_based(), memo)
    pick(table(spark, d, "orders").df, ["o_custkey"])
    return pick(table(spark, d, "orders").df, ["o_custkey"]).where(F.lit(len(memo) == 1))


@query("SELECT count(DISTINCT stripe_id) AS stripes, true AS usable, true AS alike FROM " + O)
def enc_37_random_policy(spark, d):
    """One usable encoding for each stripe, the same for the same seed."""
    rows = table(spark, d, "orders").df
    sized = advisor.estimates(rows, "o_custkey").select("stripe_id", "encoding", "size")
    first, again = (policies.random_choice(3)(rows, ["o_custkey"]).select("stripe_id", "encoding", "size") for _ in range(2))
    both = first.join(again.withColumnRenamed("encoding", "e").drop("size"), "stripe_id").join(sized.withColumn("u", F.lit(True)), ["stripe_id", "encoding", "size"], "left")
    return both.agg(F.count("*").alias("stripes"), F.bool_and(F.coalesce("u", F.lit(False))).alias("usable"), F.bool_and(F.col("e") == F.col("encoding")).alias("alike"))


@query(f"SELECT stripe_id, row_id, p_name AS v FROM {P}")
def enc_19_symbols_decode(spark, d):
    rows = codecs.column(table(spark, d, "part").df, "p_name")
    coded, codes = symbols.compress(rows)
    return symbols.expand(codes, coded)


@query("SELECT sum(octet_length(encode(p_name)))::BIGINT AS raw, true AS smaller FROM part")
def enc_19_symbol_sizes(spark, d):
    found = symbols.sizes(codecs.column(table(spark, d, "part").df, "p_name"))
    return found.select("raw", (F.col("coded") < F.col("raw")).alias("smaller"))


@query(f"SELECT stripe_id, row_id, o_orderstatus = 'O' AS v FROM {O}")
def fn_12_bool_packing(spark, d):
    """Booleans as words of 32 bits, and back."""
    rows = table(spark, d, "orders").df.select("stripe_id", "row_id", (F.col("o_orderstatus") == "O").cast("long").alias("v"))
    return codecs.unpacked(codecs.fixed_width(rows)).select("stripe_id", "row_id", (F.col("v") == 1).alias("v"))


@query(f"SELECT row_id, o_orderkey FROM {O} WHERE o_custkey % 97 = 5")
def filt_16_sparse_selection(spark, d):
    """The rows of the rarer value of a boolean, selected by their marks."""
    t = table(spark, d, "orders")
    marks = codecs.sparse_bool(t.df.select("stripe_id", "row_id", (F.col("o_custkey") % 97 == 5).alias("v")))
    return scan.selected(t, marks.where("rare")).select("row_id", "o_orderkey")


@query("SELECT row_id, vec_id, len(embedding) AS n, embedding[1]::DOUBLE AS first, label FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS row_id FROM embeddings)")
def scan_16_arrays(spark, d):
    """A column of arrays in a laid-out table."""
    t = ColTable.lay_out(read(spark, d, "embeddings"), ["vec_id"], 100, 20)
    return t.df.select("row_id", "vec_id", F.size("embedding").alias("n"), F.get("embedding", F.lit(0)).cast("double").alias("first"), "label")


@query("SELECT unnest(['vec_id', 'embedding', 'label']) AS \"column\", unnest([8 * count(*), sum(4 * len(embedding)), 4 * count(*)])::BIGINT AS bytes FROM embeddings")
def wr_19_raw_bytes_arrays(spark, d):
    return writer.raw_bytes(read(spark, d, "embeddings"))


@query("SELECT 'user_id' AS \"column\", 8 * count(*) AS bytes FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT 'm', sum(octet_length(encode(event_type)) + 8)::BIGINT FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)")
def wr_19_raw_bytes_maps(spark, d):
    return writer.raw_bytes(maps(spark, d))


# Writers.


@query(f"SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 25 AS part FROM events")
def wr_07_user_sequence(spark, d):
    return writer.cut_by_key(read(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id", 25)


@query(
    f"WITH r AS (SELECT row_id, l_returnflag AS key, row_id = 0 OR l_returnflag <> lag(l_returnflag) OVER (ORDER BY row_id) AS new FROM {L}), s AS (SELECT *, max(CASE WHEN new THEN row_id END) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS a FROM r) "
    "SELECT row_id, key, sum(CASE WHEN (row_id - a) % 2 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS stripe FROM s"
)
def wr_07_change_of_key(spark, d):
    """A stripe ends where the key changes in row order, and after two rows."""
    return writer.cut_by_change(table(spark, d, "lineitem"), "l_returnflag", 2)


@query(f"SELECT row_id, row_id // 3000 AS key, row_id // 3000 AS stripe FROM {E}")
def wr_07_long_runs(spark, d):
    """Runs of a key over several chunks."""
    rows = table(spark, d, "events").df.select(F.col("row_id").alias("place"), F.floor(F.col("row_id") / 3000).alias("key"))
    laid = ColTable.lay_out(rows, ["place"])
    return writer.cut_by_change(laid, "key").select("row_id", "key", "stripe")


@query(f"SELECT row_id, chunk_id FROM {E}")
def wr_08_chunks(spark, d):
    return table(spark, d, "events").df.select("row_id", "chunk_id")


# A stripe ends with the chunk that brings it to 60 000 bytes: a fold over chunks, as recursion in SQL.
_ESIZE = "8 + 12 + 8 + octet_length(encode(event_type)) + 8 + octet_length(encode(props))"


@query(
    f"WITH RECURSIVE c AS (SELECT chunk_id, sum({_ESIZE})::BIGINT AS b FROM {E} GROUP BY 1), s AS (SELECT 0::BIGINT AS chunk_id, 0::BIGINT AS stripe, (SELECT b FROM c WHERE chunk_id = 0) AS acc UNION ALL "
    "SELECT c.chunk_id, CASE WHEN s.acc >= 150000 THEN s.stripe + 1 ELSE s.stripe END, CASE WHEN s.acc >= 150000 THEN c.b ELSE s.acc + c.b END FROM s JOIN c ON c.chunk_id = s.chunk_id + 1) SELECT chunk_id, stripe FROM s"
)
def wr_03_cut_by_size(spark, d):
    return writer.cut_by_size(table(spark, d, "events"), 150_000)


MAPS = "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL"


def maps(spark, d):
    n = read(spark, d, "events").groupBy("user_id", "event_type").count()
    return n.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "count")))).alias("m"))


@query(f"SELECT event_type AS key, user_id, n AS value FROM ({MAPS})")
def wr_11_shredded(spark, d):
    return writer.shredded(maps(spark, d), "user_id", "m")


@query(f"SELECT event_type AS key, count(*) AS present, (SELECT count(DISTINCT user_id) FROM events) AS rows, count(*) = (SELECT count(DISTINCT user_id) FROM events) AS constant FROM ({MAPS}) GROUP BY 1")
def wr_12_in_maps(spark, d):
    return writer.in_maps(maps(spark, d), "user_id", "m")


@query("SELECT 'a' AS \"column\", count(*) FILTER (p_size % 4 = 0) AS nulls, count(*) FILTER (p_size % 4 = 0) > 0 AS kept FROM part UNION ALL SELECT 'p_partkey', 0, false FROM (SELECT 1)")
def wr_13_null_streams(spark, d):
    rows = read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("a"))
    return writer.null_streams(rows, ["a", "p_partkey"])


@query("WITH k AS (SELECT DISTINCT event_type AS t FROM events), n AS (SELECT 'm/' || t AS stream, row_number() OVER (ORDER BY t)::INT AS place FROM k), c AS (SELECT count(*)::INT AS c FROM k) SELECT 'nulls' AS stream, 0 AS place UNION ALL SELECT * FROM n UNION ALL SELECT 'user_id', c + 1 FROM c UNION ALL SELECT 'm', c + 2 FROM c")
def wr_17_stream_order(spark, d):
    """The features are the keys that the column holds."""
    shown = maps(spark, d)
    keys = [r["key"] for r in writer.in_maps(shown, "user_id", "m").orderBy("key").collect()]
    return spark.createDataFrame([(s, i) for i, s in enumerate(writer.stream_order(shown.columns, {"m": keys}))], "stream string, place int")


@query("SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS \"column\", unnest([8 * count(*), 8 * count(*), sum(octet_length(encode(o_orderstatus))), 8 * count(*), 12 * count(*), sum(octet_length(encode(o_orderpriority)))])::BIGINT AS bytes FROM orders")
def wr_19_raw_bytes(spark, d):
    return writer.raw_bytes(read(spark, d, "orders"))


@query("SELECT * FROM orders")
def ser_01_round_trip(spark, d):
    rows = read(spark, d, "orders")
    return batches.deserialize(batches.serialize(rows, 3000), rows.schema)


@query(f"SELECT stripe_id, row_id, o_orderkey, o_totalprice FROM {O} WHERE row_id % {STRIPES['orders']} % 700 BETWEEN 5 AND 14")
def ser_04_rows_of_batch(spark, d):
    """Rows 5 to 14 of each batch."""
    rows = table(spark, d, "orders").df.select("stripe_id", "row_id", "o_orderkey", "o_totalprice")
    return batches.deserialize(batches.serialize_groups(rows, "stripe_id", "row_id", 700), rows.schema, 5, 10)


