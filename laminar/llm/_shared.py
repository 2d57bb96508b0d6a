"""What the corpus operators share beside tables in the cluster's shared folder: blocks of texts and hashes of words.

Intermediate results that are read more than once, or that must survive a lost executor, are written as Parquet under
``spark.checkpoint.dir``, by ``laminar.sources.shared``.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminar.sources.shared import discard, materialize, scratch, shared_dir

U = np.uint64


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of a table that may go to all executors.
SENT = 32 << 20


def small(table: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, marked to be sent to all executors if its rows, counted, take no more than SENT bytes.

    Beyond that the join is the optimizer's, which shuffles both sides. Either way the rows are the same.
    """
    return F.broadcast(table) if table.count() * row_bytes <= SENT else table


def trimmed(run):
    """run, a function over Arrow batches, that gives freed memory back to the system when it ends.

    Python workers serve one task after another, so what the allocators hold on to would stand beside the next one's.
    """

    @functools.wraps(run)
    def inner(batches):
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where there is no glibc
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return inner


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _byte_table(pairs) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    for a, b in pairs:
        table[a] = b
    return table


#: A-Z to a-z; all other bytes stay.
LOWER = _byte_table((c, c + 32) for c in range(65, 91))
#: True for bytes of words: all but space and 0x09 to 0x0D.
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[[32, 9, 10, 11, 12, 13]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, dtype=U)]


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd multiplier modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << max(6, int(n - 1).bit_length())
        out = np.full(size, _BASE, dtype=U)
        out[0] = 1
        _POWERS[0] = np.multiply.accumulate(out)
    return _POWERS[0][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_buffers(column, limit: int = 1 << 20):
    """Blocks of an Arrow string column: (first row, byte array, row offsets from 0).

    A block holds about ``limit`` bytes, one row at least; a null counts as an empty text.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = LOWER):
    """64-bit hashes of the words of a block, in order, and for each row its range in them (n + 1 bounds).

    Words are runs of bytes other than white space; bytes are mapped by ``table`` first.
    """
    rows = len(offsets) - 1
    inside = np.flatnonzero(IN_WORD[data])
    if not len(inside):
        return np.empty(0, dtype=U), np.zeros(rows + 1, dtype=np.int64)
    begins = np.empty(len(inside), dtype=bool)
    begins[0] = True
    np.not_equal(inside[1:], inside[:-1] + 1, out=begins[1:])
    at = np.searchsorted(inside, offsets[:-1])
    begins[at[at < len(inside)]] = True
    starts = np.flatnonzero(begins)
    lengths = np.diff(starts, append=len(inside))
    place = np.arange(len(inside)) - np.repeat(starts, lengths)
    # Each byte is mixed with its place, so that no words can be made to collide as with a polynomial.
    values = mix((place.astype(U) << U(8)) + table[data[inside]] + U(1))
    hashes = mix(np.add.reduceat(values, starts) + lengths.astype(U) * U(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(inside[starts], offsets)


def shingles_of(hashes: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row its sorted distinct k-word shingles; of a row with fewer words, the whole sequence as one."""
    if len(hashes) >= k:
        rolled = np.zeros(len(hashes) - k + 1, dtype=U)
        for i in range(k):
            rolled += hashes[i : len(hashes) - k + 1 + i] * powers(k + 1)[i]
        rolled = mix(rolled)
    else:
        rolled = np.empty(0, dtype=U)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            short = (hashes[a:b] * powers(k + 1)[: b - a]).sum(dtype=U) + U(b - a)
            out.append(mix(np.array([short ^ U(0xA5A5A5A5A5A5A5A5)], dtype=U)))
        else:
            out.append(np.empty(0, dtype=U))
    return out


def text_slices(column, limit: int):
    """Ranges (first, last) of rows of an Arrow string column of about limit bytes, one row at least."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield first, last
        first = last


def gathered(flat: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the parts that stand one after another in flat, those of index, one after another; and their bounds."""
    starts, lengths = np.cumsum(sizes) - sizes, sizes[index]
    bounds = np.append(0, np.cumsum(lengths))
    return flat[np.repeat(starts[index] - bounds[:-1], lengths) + np.arange(int(bounds[-1]))], bounds


def by_stretches(texts, odd: str, whole, ids_of, lead: str = ""):
    """The ids of all texts of an Arrow string array without nulls, and the bounds of each text in them.

    Texts that match the pattern ``odd`` go to ``whole``, which gives the ids of each. Of the others, with ``lead`` before
    them, the stretches between spaces, with a line feed at the front of those that follow one, go to ``ids_of``, each
    distinct one once: it gives the ids of all, one after another, and how many each has.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = texts.cast(pa.large_string())
    strange = pc.match_substring_regex(texts, odd)
    alone = dict(zip(np.flatnonzero(strange.to_numpy(zero_copy_only=False)).tolist(), whole(texts.filter(strange).to_pylist()), strict=True))
    usual = pc.replace_substring(pc.if_else(strange, "", texts), "\n", " \n")
    led = pc.binary_join_element_wise(pa.scalar(lead, pa.large_string()), usual, pa.scalar("", pa.large_string()))
    lists = pc.split_pattern(led, " ")
    coded = lists.flatten().dictionary_encode()
    ids, ends = gathered(*ids_of(coded.dictionary), coded.indices.to_numpy())
    bounds = ends[lists.offsets.to_numpy()]
    if alone:
        parts = [alone.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))]
        ids, bounds = np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))
    return ids, bounds
