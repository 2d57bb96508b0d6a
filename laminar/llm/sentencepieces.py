"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a Viterbi in one pass.

The automaton reads a text once. At each position its output links name all pieces that end there; each relaxes the best
score of that position by the best score of its start plus its own. Positions that no piece reaches are passed by a
character of the lowest score less ten, which is written as its UTF-8 bytes' pieces. Ties go to the longer last piece.

Text is normalised as the model file says, which must be the identity with a space put in front; spaces become the
piece alphabet's space sign, and that sign itself, found in a text, is written as bytes, so that decoding gives the text
back exactly. No piece holds a space sign after another character (checked on loading), so the best path of a text is
the best paths of its stretches between spaces, each worked out once and kept in a bounded cache.

Cases: a null or empty text has no ids and decodes to the empty text; texts of any length take memory in proportion;
equal rows get equal results; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from ._shared import by_stretches, text_slices, trimmed

SPACE = "▁"
#: Below the lowest piece score, for a character that no piece covers.
UNKNOWN_PENALTY = 10.0
#: Stretches whose ids take at most so many bytes are kept, about so many of them.
CACHED_WORDS, LONG_WORD = 150_000, 64
BLOCK_BYTES = 2 << 20
_LOADED: dict[str, Pieces] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a model file, their scores, and the automaton over them."""

    #: Matches texts that do not split into stretches by single spaces and line feeds.
    ODD = rf"[ \n][ \n]|\A[ \n]|[ \n]\z|\A\z|{SPACE}"

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes_of: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        scores = []
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.bytes_of[i] = int(piece[3:5], 16)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"a piece holds a space after another character: {piece!r}")
                self.automaton.add_word(piece, (i, len(piece), model.get_score(i)))
                scores.append(model.get_score(i))
        self.automaton.make_automaton()
        self.lost = min(scores, default=0.0) - UNKNOWN_PENALTY
        self.byte_ids = {b: i for i, b in self.bytes_of.items()}
        self.letters = set("".join(p for i, p in enumerate(self.pieces) if i not in self.bytes_of))
        self.newline = self._bytes("\n") if "\n" not in self.letters else b""
        self.words: dict[str, bytes] = {}

    def _bytes(self, text: str) -> bytes:
        return np.array([self.byte_ids[b] for b in text.encode()], dtype="<u4").tobytes()

    def path(self, text: str) -> list[int]:
        """The ids of the best path through normalised text."""
        n = len(text)
        best = [0.0] + [-float("inf")] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        matches = iter(self.automaton.iter(text))
        match = next(matches, None)
        for end in range(1, n + 1):
            score, how = best[end - 1] + self.lost, (end - 1, -1)
            while match is not None and match[0] == end - 1:
                i, size, own = match[1]
                if (total := best[end - size] + own) > score:
                    score, how = total, (end - size, i)
                match = next(matches, None)
            best[end], back[end] = score, how
        out: list[int] = []
        while n:
            start, i = back[n]
            out += [i] if i >= 0 else [self.byte_ids[b] for b in reversed(text[start:n].encode())]
            n = start
        return out[::-1]

    def whole(self, text: str) -> list[int]:
        """The ids of a text, stretch by stretch: runs of space signs with what follows up to the next."""
        if not text:
            return []
        out: list[int] = []
        for k, part in enumerate((" " + text).split(SPACE)):
            if k:
                out += [self.byte_ids[b] for b in SPACE.encode()]
            for stretch in re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", part.replace(" ", SPACE)):
                out += self.path(stretch)
        return out

    def _ids_of(self, words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stretches, one after another, and how many each has: after a space, or after their line feed."""
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        get = self.words.get
        out = []
        for w in words.to_pylist():
            if (ids := get(w)) is None:
                if not w:
                    ids = b""
                elif w[0] != "\n":
                    ids = np.array(self.path(SPACE + w), dtype="<u4").tobytes()
                elif self.newline:  # no piece holds a line feed, so the path is cut there; the space before was put in
                    ids = self.newline + np.array(self.path(w[1:]), dtype="<u4").tobytes()
                else:
                    raise ValueError("pieces with line feeds are encoded whole")
                if len(ids) <= LONG_WORD:
                    self.words[w] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), dtype="<u4"), np.fromiter(map(len, out), dtype=np.int64, count=len(out)) // 4

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of an Arrow string array without nulls, and the bounds of each text in them."""
        odd = self.ODD if self.newline else self.ODD + r"|\n"
        return by_stretches(texts, odd, lambda ts: [np.array(self.whole(t), dtype="<u4") for t in ts], self._ids_of)

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        raw = bytearray()
        for i in ids:
            b = self.bytes_of.get(i)
            if b is not None:
                raw.append(b)
            else:
                raw += self.pieces[i].replace(SPACE, " ").encode()
        text = raw.decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


def load(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode(docs: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(key, n_ids, ids_crc32, n_chars, decoded) of each row; decoded: decoding the ids gives the text back.

    with_ids adds the ids, as an array column.
    """
    path = model or default_model()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        pieces = load(path)
        raw = [bytes([pieces.bytes_of[i]]) if i in pieces.bytes_of else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces.pieces)]
        sizes, joined = np.array([len(x) for x in raw]), np.frombuffer(b"".join(raw), dtype=np.uint8)
        starts = np.cumsum(sizes) - sizes
        for batch in batches:
            for first, last in text_slices(batch.column(1), BLOCK_BYTES):
                texts = pc.fill_null(batch.column(1).slice(first, last - first), "")
                ids, bounds = pieces.encode(texts)
                # Decoding, for all texts of the block at once: the bytes of all pieces in a row.
                lengths = sizes[ids] if len(ids) else np.empty(0, dtype=np.int64)
                ends = np.cumsum(lengths)
                data = joined[np.repeat(starts[ids] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
                cuts = np.concatenate([[0], ends])[bounds].tolist()
                same, crcs = [], []
                for t, a, b, i, j in zip(texts.to_pylist(), cuts[:-1], cuts[1:], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    same.append(data[a:b] == (b" " + t.encode() if t else b""))
                    crcs.append(zlib.crc32(ids[i:j].astype("<u4").tobytes()))
                columns = [batch.column(0).slice(first, last - first), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crcs, pa.int64()), pc.utf8_length(texts).cast(pa.int64()), pa.array(same, pa.bool_())]
                names = [key, "n_ids", "ids_crc32", "n_chars", "decoded"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{key}` {kind}, n_ids long, ids_crc32 long, n_chars long, decoded boolean" + (", ids array<int>" if with_ids else "")
    return docs.select(key, text).mapInArrow(trimmed(run), schema)


def decode(rows: DataFrame, model: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of each row's ids; null ids give the empty text."""
    path = model or default_model()
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [load(path).decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return rows.select(key, ids).mapInArrow(trimmed(run), f"`{key}` {kind}, text string")


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
