"""Strings by a table of symbols: up to 255 frequent substrings of one to eight bytes, each written as one byte.

After Boncz, Neumann and Leis, "FSST: fast random access string compression" (2020). The table is learned from a bounded
sample of the column in a few rounds of counting; bytes without a symbol are written after an escape.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE, SYMBOLS, LONGEST = 255, 255, 8
SAMPLE = 2000
ROUNDS = 5
#: An encoded column is kept if it is at most this share of the raw one.
KEEP = 0.6


def cutter(table: dict[bytes, int]):
    """A function that cuts bytes into the longest symbol at each place, or the one byte there, as one compiled pattern."""
    longest_first = sorted((x for x in table if len(x) > 1), key=lambda x: (-len(x), x))
    return re.compile(b"|".join([*map(re.escape, longest_first), b"."]), re.S).findall


def learn(sample: list[bytes]) -> dict[bytes, int]:
    table: dict[bytes, int] = {}
    for _ in range(ROUNDS):
        gains: Counter = Counter()
        split = cutter(table)
        for data in sample:
            parts = split(data)
            for a, b in zip(parts, [*parts[1:], b""], strict=True):
                gains[a] += len(a)
                if b and len(a) + len(b) <= LONGEST:
                    gains[a + b] += len(a) + len(b)
        best = sorted(gains.items(), key=lambda x: (-x[1], x[0]))[:SYMBOLS]
        table = {s: i for i, (s, _) in enumerate(best)}
    return table


def encoder(table: dict[bytes, int]):
    """A function that gives the codes of bytes."""
    split = cutter(table)
    codes = {bytes([i]): bytes([ESCAPE, i]) for i in range(256)} | {x: bytes([i]) for x, i in table.items()}
    return lambda data: b"".join(map(codes.__getitem__, split(data)))


def decoder(table: dict[bytes, int]):
    """A function that gives the bytes of codes: runs of codes at a time, between escaped bytes."""
    symbols = {i: x for x, i in table.items()}
    runs = re.compile(rb"\xff(.)|([^\xff]+)", re.S).findall
    return lambda data: b"".join([escaped or b"".join(map(symbols.__getitem__, run)) for escaped, run in runs(data)])


def encode(data: bytes, table: dict[bytes, int]) -> bytes:
    return encoder(table)(data)


def decode(data: bytes, table: dict[bytes, int]) -> bytes:
    return decoder(table)(data)


def compress(rows: DataFrame, seed: int = 1) -> tuple[dict[bytes, int], DataFrame]:
    """(table, rows with ``code`` bytes in place of v); the sample is about SAMPLE rows, the same on each run."""
    n, whole = rows.count(), 1 << 62
    mixed = F.xxhash64(F.lit(seed), "row_id").bitwiseAND(F.lit(whole - 1))
    drawn = rows.where(F.col("v").isNotNull() & (mixed < (whole if n <= SAMPLE else whole * SAMPLE // n))).select("v").collect()
    table = learn([r["v"].encode() for r in drawn])

    def run(batches):
        import pyarrow as pa

        coded = encoder(table)
        for batch in batches:
            codes = [None if v is None else coded(v.encode()) for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.binary())], ["stripe_id", "row_id", "code"])

    return table, rows.select("stripe_id", "row_id", "v").mapInArrow(run, "stripe_id long, row_id long, code binary")


def expand(rows: DataFrame, table: dict[bytes, int]) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        plain = decoder(table)
        for batch in batches:
            texts = [None if c is None else plain(c).decode() for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["stripe_id", "row_id", "v"])

    return rows.select("stripe_id", "row_id", "code").mapInArrow(run, "stripe_id long, row_id long, v string")


def sizes(rows: DataFrame) -> DataFrame:
    """(raw, coded, kept) of a column (v) against its codes."""
    table, coded = compress(rows)
    both = rows.select("row_id", F.octet_length("v").alias("r")).join(coded.select("row_id", F.octet_length("code").alias("c")), "row_id")
    total = both.agg(F.sum("r").alias("raw"), (F.sum("c") + sum(len(s) + 1 for s in table)).alias("coded"))
    return total.withColumn("kept", F.col("coded") <= F.col("raw") * KEEP)
