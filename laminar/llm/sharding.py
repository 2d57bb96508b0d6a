"""Jump consistent hashing: a stable key and the number of shards decide the shard, without a ring table.

Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm" (2014). The key is a 64-bit integer, or, of a key
of another type, a 64-bit checksum of its text; when shards are appended, a key either stays or moves to a new shard. The 64-bit products are taken in 16- and 32-bit limbs,
so that no step overflows a long, whatever the session's ANSI setting.

Slots number the rows of a shard from 0 in the order of (key, checksum, size). Rows are range-partitioned once by that
order and written with their range; a range's first slot is the sum of the counts before it, so no task holds a shard.

Cases: a null key hashes as key 0 and sorts first; a null text has size 1 and checksum 0, as the empty text; equal
rows get slots of their own, and any order among them gives the same rows; a very long text counts as one row of its whole
size, and only its size and checksum are shuffled; an empty table gives an empty table; extra
columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._shared import materialize, shuffle_partitions

#: Fixed value: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757
SHARDS = 8
#: Jumps after which few keys have not passed the last shard, however many shards there are.
STEPS = 40
_LOW = 0xFFFFFFFF


def _next(s: str) -> str:
    """The state after one step: key * MULTIPLIER + 1 modulo 2**64 in halves, and the bucket it jumps to."""
    high, low = MULTIPLIER >> 32, MULTIPLIER & _LOW
    times_low = f"shiftrightunsigned({s}.lo, 16) * {low}L"
    low_sum = f"(({s}.lo & 65535) * {low}L + shiftleft({times_low} & 65535, 16) + 1)"

    def product(x: str, c: int) -> str:
        """x * c modulo 2**32."""
        return f"(((({x} & 65535) * {c}L) + shiftleft(shiftrightunsigned({x}, 16) * {c & 65535}L, 16)) & {_LOW}L)"

    carry = f"shiftrightunsigned({times_low}, 16) + shiftrightunsigned({low_sum}, 32)"
    new_hi = f"(({carry} + {product(f'{s}.hi', low)} + {product(f'{s}.lo', high)}) & {_LOW}L)"
    jump = f"cast(floor(({s}.j + 1) * (2147483648D / (shiftrightunsigned(h, 1) + 1))) AS bigint)"
    return f"transform(array({new_hi}), h -> named_struct('b', {s}.j, 'j', {jump}, 'hi', h, 'lo', {low_sum} & {_LOW}L))[0]"


def jump_hash(key: str, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a bigint expression; null counts as 0.

    A key jumps about ln(shards) times. A fold has no early end, so the first STEPS jumps are one fold, and a second one
    over the rest is worked out only for the few rows that have not passed the last shard by then.
    """
    start = f"named_struct('b', -1L, 'j', 0L, 'hi', shiftrightunsigned(k, 32), 'lo', k & {_LOW}L)"

    def fold(first: int, last: int, state: str, out: str) -> str:
        return f"aggregate(sequence({first}, {last}), {state}, (s, i) -> if(s.j >= {shards}, s, {_next('s')}), s -> {out})"

    found = "cast(s.b AS int)"
    if shards > STEPS:
        found = f"if(s.j >= {shards}, {found}, {fold(STEPS + 1, shards, 's', found)})"
    return F.expr(f"transform(array(coalesce({key}, 0L)), k -> {fold(1, min(shards, STEPS), start, found)})[0]")


def _number(docs: DataFrame, key: str) -> str:
    """The key as a bigint expression: whole numbers as they are, other types by a checksum of their text."""
    if isinstance(docs.schema[key].dataType, IntegralType):
        return f"cast(`{key}` AS bigint)"
    return f"if(`{key}` IS NULL, NULL, xxhash64(cast(`{key}` AS string)))"


def number_within(rows: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """rows with a gapless number from 0 within each group, in the given order, without a task for a whole group.

    Ties are cut by a row number of no meaning, so a run of equal rows can be split among ranges as well.
    """
    spark = rows.sparkSession
    keys = [F.col(x).asc_nulls_first() for x in order]
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(shuffle_partitions(spark), *keys, "_tie").withColumn("_range", F.spark_partition_id())
    held = materialize(ranged, "numbered")
    counts = held.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*keys, "_tie"))
    numbered = held.withColumn("_place", inside).join(starts, [group, "_range"])
    return numbered.withColumn(out, (F.col("_start") + F.col("_place") - 1).cast("long")).drop("_tie", "_range", "_place", "_start")


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, grown_shard, slot) of each row of docs."""
    filled = F.coalesce(F.col(text), F.lit(""))
    digest = docs.select(
        F.col(key),
        (F.octet_length(filled) + 1).cast("long").alias("size"),
        F.crc32(filled.cast("binary")).alias("text_crc32"),
        jump_hash(_number(docs, key), shards).alias("shard"),
        jump_hash(_number(docs, key), shards + 1).alias("grown_shard"),
    )
    return number_within(digest, "shard", [key, "text_crc32", "size"], "slot")


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _oracle() -> str:
    def step(shards: int) -> str:
        return (
            f"SELECT rid, CASE WHEN j < {shards} THEN j ELSE b END AS b, "
            f"CASE WHEN j < {shards} THEN floor((j + 1) * (2147483648::DOUBLE / (((((k * {MULTIPLIER}::HUGEINT + 1) % 18446744073709551616) >> 33) + 1))))::BIGINT ELSE j END AS j, "
            f"CASE WHEN j < {shards} THEN (k * {MULTIPLIER}::HUGEINT + 1) % 18446744073709551616 ELSE k END AS k"
        )

    def chain(name: str, shards: int) -> str:
        out = [f"{name}0 AS (SELECT rid, -1::BIGINT AS b, 0::BIGINT AS j, CASE WHEN coalesce(doc_id, 0) < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END AS k FROM docs)"]
        out += [f"{name}{i} AS ({step(shards)} FROM {name}{i - 1})" for i in range(1, shards + 1)]
        return ",\n".join(out)

    table = "list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    return f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, encode(coalesce(text, '')) AS raw FROM documents),
crc_table AS (SELECT {table} AS t),
hexed AS (SELECT rid, list_transform(string_split(hex(raw), ''), lambda c: strpos('0123456789ABCDEF', c) - 1) AS d, octet_length(raw) AS n, t FROM docs, crc_table),
crc AS (SELECT rid, xor(list_reduce(list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN 4294967295::BIGINT ELSE 16 * d[2 * i - 1] + d[2 * i] END),
      lambda crc, x: xor(crc >> 8, t[((xor(crc, x)) & 255) + 1])), 4294967295)::BIGINT AS text_crc32, (n + 1)::BIGINT AS size FROM hexed),
{chain('a', SHARDS)},
{chain('g', SHARDS + 1)}
SELECT doc_id, size, text_crc32, 'key' AS law, a{SHARDS}.b::INT AS shard,
  (row_number() OVER (PARTITION BY a{SHARDS}.b ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, g{SHARDS + 1}.b::INT AS grown_shard
FROM docs JOIN crc USING (rid) JOIN a{SHARDS} USING (rid) JOIN g{SHARDS + 1} USING (rid)
"""


ORACLE = _oracle()
