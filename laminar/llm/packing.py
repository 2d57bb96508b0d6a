"""Best-two-fit packing of token pieces into sequences of at most a fixed length.

The plan is made from the histogram of piece lengths, which has as many entries as there are lengths below the sequence
length, whatever the number of documents. A sequence is filled greedily, the largest piece that fits first; then its
smallest piece is replaced by the two unpacked pieces that fit the expanded gap most tightly, if they beat it, and again
while that helps. The pattern found is repeated as often as the counts allow, so a plan has a few thousand patterns at
most. Each piece has a rank among those of its length, and the plan maps ranges of ranks to sequences and offsets.

Tokenizing is exact and fast because byte-level BPE with this split rule never merges across a space or line feed that
stands alone between other characters: such stretches are encoded once and looked up afterwards. Texts with other uses
of white space are encoded whole.

Cases: a null or empty text is one piece that holds the end id alone; equal rows are packed one by one; ties between
documents are cut by input task and order; a text of any length is cut into pieces, of which the first may be shorter;
an empty table gives an empty result; extra columns of the input are not read.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import by_stretches, gathered, materialize, text_slices, trimmed

SEQUENCE = 1024
END_ID = 2
#: Words that the tokenizer's own cache holds at most.
CACHED_WORDS = 65_536
#: Characters of texts that are given to the tokenizer at once, one text at least.
TOGETHER = 1 << 16
#: Stretches that are kept from block to block at most, and the bytes of one at most.
KEPT, KEPT_BYTES = 1 << 19, 64
#: Bytes of text that are encoded at a time, one text at least.
BLOCK_BYTES = 1 << 20
_ENCODERS: dict[tuple, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of Arrow texts, by a byte-level BPE tokenizer.

    In a text whose white space is single spaces and line feeds between other characters, a space begins a stretch that
    is encoded alone, and so do a line feed and the word after it; a full stop or comma after a letter is a stretch too.
    Stretches are known by a word and the mark before it: none for a space, a line feed, or a carriage return at the
    text's start. Each distinct one of a block is encoded once: those after spaces together, their ids told apart by the
    tokens that begin with the space. The ids of up to KEPT stretches are kept from block to block, and so from task to
    task of a worker; beyond that, the three quarters used last stay. Longer stretches than KEPT_BYTES are encoded in each block.
    """

    #: Matches a text with other uses of white space, which is encoded whole. The characters of \\s.
    UNUSUAL = (
        r"[\t\v\f\r\x1c-\x1f\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
        r"|[ \n][ \n]|\A[ \n]|[ \n]\z|\A\z"
    )
    #: Matches a word that ends in a mark, which is a stretch of its own there.
    MARKED = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}][.,]\z"

    def __init__(self, path: str, cached: int = CACHED_WORDS, kept: int = KEPT):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(cached)
        self.marks = {x: self._whole([x])[0] for x in ".,\n"}
        self.after_space = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.after_space[i] = token.startswith("\u0120")  # how byte-level vocabularies write a space
        # Kept stretches, their ids one after another, how many each has, and the block that used each last.
        self.kept, self.block = kept, 0
        self.words, self.ids = pa.array([], pa.large_string()), np.empty(0, dtype="<u4")
        self.sizes, self.used = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, a few texts at a time."""
        out, part, size = [], [], 0
        for text in [*texts, None]:
            if part and (text is None or size + len(text) > TOGETHER):
                out += [np.array(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                part, size = [], 0
            if text is not None:
                part.append(text)
                size += len(text)
        return out

    def _spaced(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of all words with a space before each, and how many each has, in parts."""
        ids, sizes = [], []
        for i in range(0, len(words), 2_000):
            part = words[i : i + 2_000]
            found = self._whole([" " + " ".join(part)])[0]
            cuts = np.flatnonzero(self.after_space[found])
            assert len(cuts) == len(part)
            ids.append(found)
            sizes.append(np.diff(cuts, append=len(found)))
        return ids, sizes

    def _ids_of(self, words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow array of distinct stretches, one after another, and how many each has."""
        import pyarrow as pa
        import pyarrow.compute as pc

        marked = pc.match_substring_regex(words, self.MARKED)
        stems = pc.if_else(marked, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
        index, known = stems.indices.to_numpy(), stems.dictionary
        led = pc.match_substring_regex(known, r"\A[\n\r]").to_numpy(zero_copy_only=False)
        ids, sizes = self._spaced(known.filter(pa.array(~led)).to_pylist())
        starting = known.filter(pa.array(led)).to_pylist()
        for word, own in zip(starting, self._whole([w[1:] for w in starting]), strict=True):
            ids += [self.marks["\n"], own] if word[0] == "\n" else [own]
            sizes.append(np.array([len(own) + (len(self.marks["\n"]) if word[0] == "\n" else 0)]))
        place = np.empty(len(led), dtype=np.int64)
        place[np.append(np.flatnonzero(~led), np.flatnonzero(led))] = np.arange(len(led))
        flat, bounds = gathered(*_joined(ids, sizes), place[index])
        ended = marked.to_numpy(zero_copy_only=False)
        if not ended.any():
            return flat, np.diff(bounds)
        last = pc.utf8_slice_codeunits(words.filter(marked), -1, 2**31 - 1)
        comma = pc.equal(last, ",").to_numpy(zero_copy_only=False)
        assert len(self.marks["."]) == len(self.marks[","]) == 1
        return np.insert(flat, bounds[1:][ended], np.where(comma, self.marks[","][0], self.marks["."][0])), np.diff(bounds) + ended

    def _looked_up(self, words) -> tuple[np.ndarray, np.ndarray]:
        """What _ids_of gives, from the kept stretches where they have it; the others are kept afterwards."""
        import pyarrow as pa
        import pyarrow.compute as pc

        at = pc.index_in(words, value_set=self.words)
        new = words.filter(at.is_null())
        index = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.block += 1
        self.used[index[index >= 0]] = self.block
        index[index < 0] = len(self.words) + np.arange(len(new))
        ids, sizes = self._ids_of(new)
        ids, sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        short = len(self.words) + np.flatnonzero(pc.binary_length(new).to_numpy(zero_copy_only=False) <= KEPT_BYTES)
        used = np.concatenate([self.used, np.full(len(new), self.block)])
        stay = np.append(np.arange(len(self.words)), short)
        if len(stay) > self.kept:
            stay = stay[np.argsort(-used[stay], kind="stable")[: self.kept * 3 // 4]]
        self.words = pa.concat_arrays([self.words, new]).take(pa.array(stay))
        self.ids, self.sizes, self.used = gathered(ids, sizes, stay)[0], sizes[stay], used[stay]
        return gathered(ids, sizes, index)[0], sizes[index]

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of an Arrow string array without nulls, and the bounds of each text in them."""
        return by_stretches(texts, self.UNUSUAL, self._whole, self._looked_up, "\r")


def _joined(ids: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate(ids), np.concatenate(sizes)) if sizes else (np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64))


def encoder(path: str) -> Encoder:
    if (path,) not in _ENCODERS:
        _ENCODERS[(path,)] = Encoder(path)
    return _ENCODERS[(path,)]


class Pieces(NamedTuple):
    """Pieces of texts: the row of each, its place, start and length in it, its checksum; and all ids, one after another."""

    row: np.ndarray
    piece: np.ndarray
    start: np.ndarray
    length: np.ndarray
    crc: np.ndarray
    ids: np.ndarray


def pieces_of(ids: np.ndarray, bounds: np.ndarray, limit: int, end_id: int) -> Pieces:
    """Cuts the ids of each text, with end_id after them, into full pieces, but for the first."""
    sizes = np.diff(bounds) + 1
    ends = np.cumsum(sizes)
    whole = np.full(int(ends[-1]) if len(ends) else 0, end_id, dtype="<u4")
    inside = np.ones(len(whole), dtype=bool)
    inside[ends - 1] = False
    whole[inside] = ids[bounds[0] : bounds[-1]]
    counts = -(-sizes // limit)
    row = np.repeat(np.arange(len(sizes)), counts)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = (sizes - (counts - 1) * limit)[row]
    start = np.where(piece, first + (piece - 1) * limit, 0)
    length = np.where(piece, limit, first)
    cuts, data = np.append(0, np.cumsum(length)) * 4, memoryview(whole.tobytes())
    crc = np.fromiter((zlib.crc32(data[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)), dtype=np.int64, count=len(row))
    return Pieces(row, piece, start, length, crc, whole)


def _by_value(values: np.ndarray):
    """(value, its places in order) of each distinct value."""
    order = np.argsort(values, kind="stable")
    if len(order):
        for own in np.split(order, np.flatnonzero(np.diff(values[order])) + 1):
            yield int(values[own[0]]), own


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


def pieces(docs: DataFrame, limit: int = SEQUENCE, tokenizer: str | None = None, end_id: int = END_ID, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of each document: key, piece, start, length, checksum, and the rank in its task and length.

    with_ids adds the ids themselves, as an array column.
    """
    path = tokenizer or default_tokenizer()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        task, ranks, enc = TaskContext.get().partitionId(), np.zeros(limit + 1, dtype=np.int64), encoder(path)
        for batch in batches:
            for first, last in text_slices(batch.column(1), BLOCK_BYTES):
                keys = batch.column(0).slice(first, last - first)
                ids, bounds = enc.encode(pc.fill_null(batch.column(1).slice(first, last - first), ""))
                found = pieces_of(ids, bounds, limit, end_id)
                places = []
                for n, order in _by_value(found.length):
                    places.append((order, ranks[n] + np.arange(len(order))))
                    ranks[n] += len(order)
                rank = np.empty(len(found.row), dtype=np.int64)
                for order, place in places:
                    rank[order] = place
                columns = [keys.take(pa.array(found.row)), pa.array(found.piece.astype(np.int32)), pa.array(found.start), pa.array(found.length)]
                columns += [pa.array(found.crc), pa.array(np.full(len(rank), task, dtype=np.int32)), pa.array(rank)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
                if with_ids:
                    columns.append(pa.LargeListArray.from_arrays(np.append(0, np.cumsum(found.length)), found.ids.astype(np.int64)).cast(pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = PIECES + (", ids array<long>" if with_ids else "")
    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(trimmed(run), schema)


def plan(counts: dict[int, int], limit: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """(lengths, how many sequences hold them) for pieces counted by length, all below limit."""
    left = np.zeros(limit + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    lengths = np.arange(limit + 1)

    def fitting() -> np.ndarray:
        """For each room the largest length that is left and fits; 0: none."""
        return np.maximum.accumulate(np.where(left > 0, lengths, 0))

    out = []
    while left.any():
        used: list[int] = []
        room, fits = limit, fitting()
        while size := int(fits[room]):
            used.append(size)
            left[size] -= 1
            room -= size
            if not left[size]:
                fits = fitting()
        while room and (pair := _two(left, fits, room + used[-1])) and sum(pair) > used[-1]:
            left[used[-1]] += 1
            room += used.pop() - sum(pair)
            for size in pair:
                left[size] -= 1
            used = sorted([*used, *pair], reverse=True)
            fits = fitting()
        kinds, each = np.unique(used, return_counts=True)
        more = int((left[kinds] // each).min())
        left[kinds] -= more * each
        out.append((used, more + 1))
    return out


def _two(left: np.ndarray, fits: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two lengths left that fill room best, the larger first."""
    small = np.flatnonzero(left[: room // 2 + 1])
    small = small[small > 0]
    if not len(small):
        return None
    large = fits[room - small]
    alone = (large == small) & (left[small] < 2)
    total = np.where((large >= small) & ~alone, small + large, 0)
    best = int(total.argmax())
    return (int(large[best]), int(small[best])) if total[best] else None


def layout(patterns: list[tuple[list[int], int]], limit: int = SEQUENCE) -> dict[int, np.ndarray]:
    """By length, rows of (first rank, first sequence, pieces of that length in each sequence, first offset)."""
    out: dict[int, list] = {}
    taken, sequence = [0] * (limit + 1), 0
    for used, times in patterns:
        offset = 0
        for size in sorted(set(used), reverse=True):
            n = used.count(size)
            out.setdefault(size, []).append((taken[size], sequence, n, offset))
            taken[size] += n * times
            offset += n * size
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(held: DataFrame, limit: int = SEQUENCE) -> DataFrame:
    """Pieces, written, with their sequence and offset. A full piece is a sequence of its own, with a negative number."""
    short = held.where(F.col("length") < limit)
    counted = short.groupBy("length", "task").agg(F.count("*").alias("n"))
    patterns = plan({r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}, limit)
    where = layout(patterns, limit)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(size), dtype=np.int64), np.empty(len(size), dtype=np.int64)
            for s in np.unique(size):
                own, rows = np.flatnonzero(size == s), where[int(s)]
                k = np.searchsorted(rows[:, 0], rank[own], side="right") - 1
                done = rank[own] - rows[k, 0]
                sequence[own] = rows[k, 1] + done // rows[k, 2]
                offset[own] = rows[k, 3] + done % rows[k, 2] * s
            kept = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = short.join(firsts, ["length", "task"]).select(*own, (F.col("rank") + F.col("first")).alias("rank"))
    single = (-1 - F.col("task").cast("long") * F.lit(1 << 33) - F.col("rank")).alias("sequence_id")
    full = held.where(F.col("length") >= limit).select(*own, single, F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(trimmed(place), PACKED).unionByName(full)


def pack_documents(docs: DataFrame, limit: int = SEQUENCE, tokenizer: str | None = None) -> DataFrame:
    return pack(materialize(pieces(docs, limit, tokenizer), "pieces"), limit)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
