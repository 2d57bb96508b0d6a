"""Language identification of spans: scripts narrow the candidates, and a Viterbi path over the words labels them.

Training reads a bounded sample of each language's labelled texts, so that every label is learned, and counts, for each
language, its words and the character n-grams of words with their boundaries, each hashed into a fixed number of columns;
all that is counted counts. A word's score under a language is its smoothed log-probability as a word plus those of its
n-grams, less the best language's, and clipped; only languages seen in a script of the word's letters compete, and a word
without letters, or in a script no language was seen in, scores alike for all. Within a text, the best labelling of the
words pays ``SWITCH`` for each change of language.

Texts are taken in blocks of ``BLOCK_BYTES``, one text at least, and each distinct word of a block is scored once, all of
them in arrays; nothing is kept from block to block but the model. Where one language leads so far that no stretch of
words gains more than half the penalty under another, the best path is that language alone; this is tested on cumulative
scores, and it holds for nearly all texts. The others go through the full recursion.

The prediction is the language of most letters. The score is the share of letters in its spans times the mean posterior
of its lead, between 0 and 1.

Cases: a null or empty text, or one without letters (digits, signs, or combining marks alone), is ``und`` with score 0; a
very long text is labelled whole, as a block of its own, in memory in proportion to its words times the languages; ties go
to the language that comes first by name; a language with one training text is learned like any other; without any
training text all is ``und``; equal rows get equal results; an empty table gives an empty table; extra columns are not
read, but for ``keep``, which returns them as they are. lang values that are null do not train.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import U, gathered, materialize, mix, text_slices, trimmed

#: At most about so many labelled texts of each language train, drawn by a checksum of the key.
TRAIN_DOCS = 4000
GRAM = 3
#: Words, and n-grams, are hashed into 2**BITS columns each; the model has four bytes for each column and language.
BITS = 18
SWITCH = 12.0
CLIP = 6.0
UNKNOWN = "und"
BLOCK_BYTES = 1 << 19
#: First code points of ranges of letters by script, in order; code points before the first are Latin.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1400, "Canadian"), (0x1680, "Other"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"),
    (0x2C00, "Other"), (0x2C60, "Latin"), (0x2C80, "Greek"), (0x2D00, "Other"), (0x2DE0, "Cyrillic"),
    (0x2E00, "Other"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"),
    (0x31F0, "Kana"), (0x3200, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"),
    (0xA720, "Latin"), (0xA800, "Other"), (0xAB30, "Latin"), (0xAB70, "Cherokee"), (0xABC0, "Other"),
    (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"),
    (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x1B000, "Kana"), (0x1F000, "Other"), (0x20000, "Han"),
)
_BOUNDS = np.array([x for x, _ in SCRIPTS])
NAMES = sorted({x for _, x in SCRIPTS})
#: Kinds of characters, and the first code point beyond all letters.
OTHER, LETTER, MARK, WHITE = 0, 1, 2, 3
BEYOND = 0x32400
#: Stand before and after each word's letters.
BEFORE, AFTER = 0x110000, 0x110001


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: its kind, its lower case, and the bit of its script."""
    kind, lower = np.zeros(BEYOND + 1, dtype=np.uint8), np.arange(BEYOND + 1, dtype=np.uint32)
    for i in range(BEYOND):
        c = chr(i)
        if c.isalpha():
            kind[i], lower[i] = LETTER, ord(c.lower()[0])
        elif c.isspace():
            kind[i] = WHITE
        elif unicodedata.category(c)[0] == "M":
            kind[i] = MARK
    at = [NAMES.index(x) for _, x in SCRIPTS]
    bits = U(1) << np.array(at, dtype=U)[np.searchsorted(_BOUNDS, np.arange(BEYOND + 1), side="right") - 1]
    return kind, lower, bits


def script(c: str) -> str:
    """The script of a letter; empty for other characters."""
    return SCRIPTS[int(np.searchsorted(_BOUNDS, ord(c), side="right")) - 1][1] if c.isalpha() else ""


class Words(NamedTuple):
    """The words of texts: each text's range of them, their letters, and which distinct one each is (-1: no letters).

    Of the distinct ones: their code points, letters and marks in lower case, one word after another, how many each has,
    and the bits of their scripts.
    """

    bounds: np.ndarray
    letters: np.ndarray
    which: np.ndarray
    points: np.ndarray
    sizes: np.ndarray
    scripts: np.ndarray


def words_of(texts: list[str]) -> Words:
    """Words are runs of characters other than white space, in composed form."""
    kinds, lower, bits = _characters()
    texts = [t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in texts]
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), dtype="<u4")
    kind = kinds[np.minimum(points, BEYOND)]
    inside = kind != WHITE
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = np.flatnonzero(begins)
    ends = np.cumsum([0, *[len(t) + 1 for t in texts]])
    bounds = np.searchsorted(starts, ends)
    at = np.flatnonzero((kind == LETTER) | (kind == MARK))
    word = np.cumsum(begins)[at] - 1
    letters = np.bincount(word[kind[at] == LETTER], minlength=len(starts)).astype(np.int64)
    at, word = at[letters[word] > 0], word[letters[word] > 0]
    which = np.full(len(starts), -1, dtype=np.int64)
    if not len(at):
        return Words(bounds, letters, which, np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64), np.empty(0, dtype=U))
    own = lower[points[at]]
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    sizes = np.diff(first, append=len(word))
    place = (np.arange(len(word)) - np.repeat(first, sizes)).astype(U)
    hashes = np.add.reduceat(mix(own.astype(U) + (place << U(32))), first)
    _, example, found = np.unique(hashes, return_index=True, return_inverse=True)
    which[word[first]] = found
    flat, _ = gathered(own, sizes, example)
    scripts, _ = gathered(np.where(kind[at] == LETTER, bits[points[at]], U(0)), sizes, example)
    sizes = sizes[example]
    return Words(bounds, letters, which, flat, sizes, np.bitwise_or.reduceat(scripts, np.cumsum(sizes) - sizes))


def columns_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct words: the column of each as a word, the columns of all n-grams, and how many each word has."""
    n = len(words.sizes)
    ends = np.cumsum(words.sizes)
    bounded = np.insert(words.points, np.append(ends - words.sizes, ends), np.repeat([BEFORE, AFTER], n)).astype(U)
    sizes = words.sizes + 2
    starts = np.cumsum(sizes) - sizes
    place = (np.arange(len(bounded)) - np.repeat(starts, sizes)).astype(U)
    whole = mix(np.add.reduceat(mix(bounded + (place << U(32))), starts)) if n else np.empty(0, dtype=U)
    rolled = np.zeros(max(0, len(bounded) - GRAM + 1), dtype=U)
    for i in range(GRAM):
        rolled = mix(rolled + bounded[i : len(bounded) - GRAM + 1 + i])
    counts = sizes - GRAM + 1
    inside = np.ones(len(rolled), dtype=bool)
    for i in range(1, GRAM):  # windows that reach into the next word
        inside[starts[1:] - i] = False
    shift = U(64 - BITS)
    return (whole >> shift).astype(np.int64), (rolled[inside] >> shift).astype(np.int64), counts


@dataclass
class Model:
    """Log-probabilities by column and language, as words and as n-grams, and the bits of each language's scripts."""

    langs: list[str]
    words: np.ndarray
    grams: np.ndarray
    scripts: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """Of distinct words: for each language a value, 0 for those that lead; zeros if nothing speaks."""
        if not len(words.sizes) or not self.langs:
            return np.zeros((len(words.sizes), len(self.langs)), dtype=np.float32)
        whole, grams, counts = columns_of(words)
        out = np.add.reduceat(self.grams[grams], np.cumsum(counts) - counts, axis=0) + self.words[whole]
        out[(words.scripts[:, None] & self.scripts[None, :]) == 0] = -np.inf
        top = out.max(axis=1, keepdims=True)
        fine = np.isfinite(top)
        return np.where(fine, np.maximum(out - np.where(fine, top, 0), -CLIP), 0).astype(np.float32)


def _table(counts: np.ndarray) -> np.ndarray:
    """Smoothed log-probabilities by column and language; zeros where nothing was counted."""
    seen = counts.sum(axis=1) > 0
    rows = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * max(1, int(seen.sum()))))
    return np.where(seen[:, None], rows, 0).astype(np.float32)


#: The places of words, n-grams and scripts among what is counted.
AT_GRAMS, AT_SCRIPTS = 1 << BITS, 2 << BITS


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of what texts hold."""
    words = words_of(texts)
    whole, grams, counts = columns_of(words)
    times = np.bincount(words.which[words.which >= 0], minlength=len(words.sizes))
    scripts = [(AT_SCRIPTS + i, int(times[(words.scripts >> U(i)) & U(1) == 1].sum())) for i in range(len(NAMES))]
    found = np.bincount(whole, weights=times, minlength=1 << BITS), np.bincount(grams, weights=np.repeat(times, counts), minlength=1 << BITS)
    both = np.concatenate(found).astype(np.int64)
    at = np.flatnonzero(both)
    seen = [(i, n) for i, n in scripts if n]
    return np.append(at, [i for i, _ in seen]).astype(np.int64), np.append(both[at], [n for _, n in seen]).astype(np.int64)


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """From each language's places and counts."""
    langs = sorted(counts)
    table, scripts = np.zeros((2 << BITS, len(langs))), np.zeros(len(langs), dtype=U)
    for k, lang in enumerate(langs):
        for at, n in zip(*(x[(y := counts[lang][0]) >= AT_SCRIPTS] for x in counts[lang]), strict=True):
            scripts[k] |= U(1) << U(int(at) - AT_SCRIPTS) if n else U(0)
        low = y < AT_SCRIPTS
        table[y[low], k] = counts[lang][1][low]
    return Model(langs, _table(table[:AT_GRAMS]), _table(table[AT_GRAMS:]), scripts)


def viterbi(texts: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """For the word scores of each text the labels on the best path; ties go to the earlier language, and to staying.

    All texts take their n-th word at once, the longest first, so that those still going on stand in front.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], dtype=np.int64)
    if not len(sizes) or not sizes[0]:
        return [np.empty(0, dtype=np.int64) for _ in texts]
    going = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
    at = np.cumsum(going) - going
    k = texts[0].shape[1]
    scores, back, out = np.empty((int(sizes.sum()), k)), np.empty((int(sizes.sum()), k), dtype=np.int16), np.empty(int(sizes.sum()), dtype=np.int64)
    for r, i in enumerate(order):
        scores[at[: sizes[r]] + r] = texts[i]
    value, stay, rows = scores[: going[0]].copy(), np.arange(k, dtype=np.int16), np.arange(len(sizes))
    for t in range(1, int(sizes[0])):
        m, a = int(going[t]), int(at[t])
        own = value[:m]
        best = own.argmax(axis=1)
        gain = (own[rows[:m], best] - switch)[:, None]
        moves = gain > own
        back[a : a + m] = np.where(moves, best[:, None], stay)
        value[:m] = np.where(moves, gain, own) + scores[a : a + m]
    label = value.argmax(axis=1)
    for t in range(int(sizes[0]) - 1, -1, -1):
        m, a = int(going[t]), int(at[t])
        out[a : a + m] = label[:m]
        if t:
            label[:m] = back[a + rows[:m], label[:m]]
    found: list[np.ndarray] = [out[:0]] * len(texts)
    for r, i in enumerate(order):
        found[i] = out[at[: sizes[r]] + r]
    return found


def settled(scores: np.ndarray, switch: float) -> int:
    """The language that alone is the best path, or -1 if the test does not tell.

    A path with q >= 1 switches has at most q + 1 <= 2q stretches in other languages; if none of them gains more than
    half the penalty over the leader, the path gains no more than it pays.
    """
    scores = scores.astype(np.float64)
    lead = int(scores.sum(axis=0).argmax())
    gains = np.cumsum(scores - scores[:, lead : lead + 1], axis=0)
    lows = np.minimum.accumulate(np.vstack([np.zeros(scores.shape[1]), gains[:-1]]), axis=0)
    return lead if (gains - lows).max() <= switch / 2 else -1


class Labeller:
    """Labels the words of texts."""

    def __init__(self, model: Model, switch: float = SWITCH):
        self.model, self.switch = model, switch

    def label(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text: the language of each word as an index, the words' scores, and their letters."""
        words = words_of(texts)
        # The last row is for words without letters.
        values = np.vstack([self.model.scores(words), np.zeros((1, len(self.model.langs)), dtype=np.float32)])
        ranges = list(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True))
        leads, open_ = [0] * len(ranges), []
        for i, (a, b) in enumerate(ranges):
            if a < b and self.model.langs and (lead := settled(values[words.which[a:b]], self.switch)) != 0:
                leads[i] = lead
                if lead < 0:
                    open_.append(i)
        paths = dict(zip(open_, viterbi([values[words.which[slice(*ranges[i])]] for i in open_], self.switch), strict=True))
        for i, (a, b) in enumerate(ranges):
            yield paths[i] if i in paths else np.full(b - a, leads[i]), values[words.which[a:b]], words.letters[a:b]

    def predict(self, labels: np.ndarray, scores: np.ndarray, letters: np.ndarray) -> tuple[str, float, int]:
        """The language of most letters, its score, and the number of spans."""
        if not len(labels) or not self.model.langs or not (total := int(letters.sum())):
            return UNKNOWN, 0.0, 0
        share = np.bincount(labels, weights=letters, minlength=len(self.model.langs))
        best = int(share.argmax())
        own = scores[labels == best].sum(axis=0, dtype=np.float64)
        posterior = 1 / np.exp(np.clip(own - own[best], -50, 0)).sum()
        return self.model.langs[best], float(share[best] / total * posterior), int(np.count_nonzero(np.diff(labels))) + 1

    def spans(self, text: str, labels: np.ndarray, letters: np.ndarray) -> list[tuple[str, str]]:
        """(language, words) of each stretch in one language."""
        own = text.split()
        if not own or not letters.any() or not self.model.langs:
            return [(UNKNOWN, " ".join(own))] if own else []
        cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(own)]
        return [(self.model.langs[labels[a]], " ".join(own[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def fold(key: str = "doc_id", parts: int = 5) -> Column:
    """The checksum of the key as text, modulo parts; of a null key, -1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts, F.lit(-1))


#: Checksums of keys lie below this, so shares of any table can be told apart.
WHOLE = 1 << 62


def mixed(key: str) -> Column:
    """A checksum of the key, from 0 to WHOLE - 1, that draws samples; null keys have one too."""
    return F.xxhash64(F.col(key).cast("string"), F.lit("sample")).bitwiseAND(F.lit(WHOLE - 1))


def bound(limit: int, n: int) -> int:
    """The checksums below it are those of about limit of n keys; WHOLE, if there are no more."""
    return WHOLE if n <= limit else max(1, WHOLE * limit // n)


def sample_each(labelled: DataFrame, limit: int, key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """About limit rows of each lang, those with the smallest mixed checksums of the key; all, if it has no more.

    The shares taken follow from a count by lang. Which rows it takes depends on nothing but the keys and the counts. The
    smallest checksum of a lang is always taken, so none is left out.
    """
    counts = labelled.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n"), F.min(mixed(key)).alias("least")).where(F.col("n") > limit).collect()
    if not counts:
        return labelled
    bounds = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], max(bound(limit, r["n"]), r["least"] + 1))])
    return labelled.where(mixed(key) < F.coalesce(bounds[F.col(lang)], F.lit(WHOLE)))


def train(docs: DataFrame, limit: int = TRAIN_DOCS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fits on a sample, for each lang, of the rows outside fold 0 whose lang is not null.

    Counting is done on the executors; for each language at most a count for each place comes to the driver.
    """
    rows = sample_each(docs.where((fold(key) > 0) & F.col(lang).isNotNull() & F.col(text).isNotNull()), limit, key, lang)

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for first, last in text_slices(batch.column(0), BLOCK_BYTES):
                own = batch.slice(first, last - first)
                names = np.array(own.column(1).to_pylist(), dtype=object)
                for name in sorted(set(names.tolist())):
                    at, n = counted(own.column(0).filter(pa.array(names == name)).to_pylist())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n)], ["lang", "at", "n"])

    found = rows.select(F.col(text), F.col(lang)).mapInArrow(trimmed(count), "lang string, at long, n long")
    totals = materialize(found.groupBy("lang", "at").agg(F.sum("n").alias("n")), "counts")
    counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for name in sorted({r["lang"] for r in rows.select(F.col(lang).alias("lang")).distinct().collect()}):
        own = totals.where(F.col("lang") == name).select("at", "n").toArrow()
        counts[name] = own.column("at").to_numpy(), own.column("n").to_numpy()
    return fit(counts)


def label(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """(key, lang_pred, score, n_spans) of each row of docs, and its spans as an array of (lang, text) if asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size for each language
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        labeller = Labeller(shared.value)
        for batch in batches:
            for first, last in text_slices(batch.column(1), BLOCK_BYTES):
                part = batch.slice(first, last - first)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found, pairs = [], []
                for t, x in zip(texts, labeller.label(texts), strict=True):
                    found.append(labeller.predict(*x))
                    if spans:
                        pairs.append([{"lang": a, "text": b} for a, b in labeller.spans(t, x[0], x[2])])
                columns = [part.column(0), *(pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.int32())))]
                names = [key, "lang_pred", "score", "n_spans"]
                if spans:
                    columns.append(pa.array(pairs, pa.list_(pa.struct([("lang", pa.string()), ("text", pa.string())]))))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{key}` {kind}, lang_pred string, score double, n_spans int" + (", spans array<struct<lang: string, text: string>>" if spans else "")
    return docs.select(key, text).mapInArrow(trimmed(run), schema)


def keep(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that have a language with a score of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size for each language
    at = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        labeller = Labeller(shared.value)
        for batch in batches:
            for first, last in text_slices(batch.column(at), BLOCK_BYTES):
                part = batch.slice(first, last - first)
                found = [labeller.predict(*x) for x in labeller.label([t or "" for t in part.column(at).to_pylist()])]
                yield part.filter(pa.array([name != UNKNOWN and score >= least for name, score, _ in found], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return label(docs, train(docs)).select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "n_spans")
