"""A quality classifier: naive Bayes support vectors over n-gram indicators.

Wang and Manning, "Baselines and bigrams" (2012): an indicator of each n-gram is scaled by its log-count ratio between
the classes, and a linear model with hinge loss is fitted by dual coordinate descent (Hsieh et al., 2008). The n-grams
are words, and one to three successive word shapes, in which runs of letters of one case and of digits are one sign,
other characters stay, and a word equal to the one before has a sign of its own. They are hashed into a fixed number of
columns. Rows are scaled to unit length; margins of rows left out of a fit give the slope and offset that turn margins
into probabilities.

At most TRAIN_DOCS labelled rows train, those with the smallest checksums of their keys; their distinct columns come to
the driver.

Cases: a null or empty text has no n-grams and scores by the model's offset alone; a very long one is taken whole, as a
block of its own; equal rows score the same, and among equal checksums the smaller label and columns train; labels that
are null, or whose key is, do not train, and a key labelled more than once trains once for each label; if the training rows have
one class or none, each score is that class's share, or 0.5; an empty table gives an empty table; extra columns are not
read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import IN_WORD, LOWER, U, mix, powers, text_buffers, trimmed, words_of
from .language_id import bound, fold, mixed

TRAIN_DOCS = 6000
BITS = 20
COST = 1.0
EPOCHS = 12
SMOOTHING = 1.0
SEED = 7


def _shape_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("a") : ord("z") + 1] = table[128:] = ord("a")
    table[ord("A") : ord("Z") + 1] = ord("A")
    table[ord("0") : ord("9") + 1] = ord("0")
    return table


SHAPE = _shape_table()


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text of a block its distinct columns, sorted."""
    words, bounds = words_of(data, offsets, LOWER)
    if not len(words):
        return [np.empty(0, dtype=np.int64)] * (len(offsets) - 1)
    shaped = SHAPE[data]
    keep = np.ones(len(shaped), dtype=bool)
    keep[1:] = (shaped[1:] != shaped[:-1]) | ~IN_WORD[data[1:]]
    keep[offsets[:-1][offsets[:-1] < len(keep)]] = True
    shapes, _ = words_of(shaped[keep], np.concatenate([[0], np.cumsum(keep)])[offsets], np.arange(256, dtype=np.uint8))
    again = np.zeros(len(words), dtype=bool)
    again[1:] = words[1:] == words[:-1]
    again[bounds[:-1][bounds[:-1] < len(again)]] = False
    shapes = np.where(again, U(0x1234567), shapes)
    parts = [words * U(3), shapes * U(5)]
    for n in (2, 3):
        rolled = np.zeros(max(0, len(shapes) - n + 1), dtype=U)
        for i in range(n):
            rolled += shapes[i : len(shapes) - n + 1 + i] * powers(8)[i + 1]
        parts.append(mix(rolled + U(n)))
    columns = [(mix(x) >> U(64 - BITS)).astype(np.int64) for x in parts]
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = [columns[0][a:b], columns[1][a:b], columns[2][a : max(a, b - 1)], columns[3][a : max(a, b - 2)]]
        out.append(np.unique(np.concatenate(own)))
    return out


@dataclass
class Model:
    """weight: ratio times fitted weight, by column; square: the ratio's square; slope and offset of the probability."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, columns: list[np.ndarray]) -> np.ndarray:
        margins = np.array([self.weight[c].sum() / np.sqrt(max(self.square[c].sum(), 1e-12)) + self.bias for c in columns])
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -500, 500)))


def ratios(rows: list[np.ndarray], labels: np.ndarray, columns: int) -> np.ndarray:
    """log of each column's smoothed share among rows of label 1 over that among rows of label 0."""
    counts = []
    for v in (1, 0):
        own = [r for r, y in zip(rows, labels.tolist(), strict=True) if y == v]
        counts.append(np.bincount(np.concatenate(own) if own else np.empty(0, dtype=np.int64), minlength=columns) + SMOOTHING)
    seen = (counts[0] + counts[1]) > 2 * SMOOTHING
    return np.where(seen, np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum()), 0.0)


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, columns: int, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise half the squared norm plus cost times the hinge losses, row by row in the dual."""
    weight, bias, dual = np.zeros(columns), 0.0, np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.default_rng(SEED)
    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            slack = signs[i] * (float(weight[rows[i]] @ values[i]) + bias) - 1
            new = min(max(dual[i] - slack / norms[i], 0.0), cost)
            if step := (new - dual[i]) * signs[i]:
                weight[rows[i]] += step * values[i]
                bias += step
                dual[i] = new
    return weight, bias


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins, by Newton's method with smoothed targets."""
    pos, neg = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, b = np.stack([margins, np.ones_like(margins)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (target - p))
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(b[0], 1e-3)), float(b[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, columns: int = 1 << BITS) -> Model:
    if len(rows) < 4 or len(set(labels.tolist())) < 2:
        share = min(max(float(labels.mean()) if len(labels) else 0.5, 1e-6), 1 - 1e-6)
        none = np.zeros(columns)
        return Model(none, none, 0.0, 1.0, float(np.log(share / (1 - share))))

    def once(own: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
        ratio = ratios([rows[i] for i in own], labels[own], columns)
        values = [(v / n if (n := np.linalg.norm(v := ratio[rows[i]])) else v) for i in own]
        weight, bias = dual_descent([rows[i] for i in own], values, 2.0 * labels[own] - 1, columns)
        return weight * ratio, ratio * ratio, bias

    margins, part = np.zeros(len(rows)), np.random.default_rng(SEED).permutation(len(rows)) % 3
    for f in range(3):
        weight, square, bias = once(np.flatnonzero(part != f).tolist())
        for i in np.flatnonzero(part == f).tolist():
            margins[i] = weight[rows[i]].sum() / np.sqrt(max(square[rows[i]].sum(), 1e-12)) + bias
    slope, offset = calibrate(margins, labels)
    weight, square, bias = once(list(range(len(rows))))
    return Model(weight.astype(np.float32), square.astype(np.float32), bias, slope, offset)


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fits on a sample of the labelled rows outside fold 1 of 3: at most limit labels, and at most limit rows of docs."""
    fine = labels.where((fold(key, 3) != 1) & F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key), F.col(label).cast("int").alias("label"), mixed(key).alias("draw"))
    # A share by checksum first, so that few rows are sorted; then a limit by rank, as one key can have many labels.
    drawn = fine.where(F.col("draw") < bound(2 * limit, fine.count())).orderBy("draw", key, "label").limit(limit)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, data, offsets in text_buffers(batch.column(1)):
                found = [c.astype("<i4").tobytes() for c in features(data, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(found)), pa.array(found, pa.binary()), batch.column(2).slice(first, len(found))], ["draw", "columns", "label"])

    # At most limit labels, so they can go to every task; a key can have many rows, so those are limited again.
    rows = docs.select(key, text).join(F.broadcast(drawn), key).select("draw", text, "label")
    table = rows.mapInArrow(trimmed(run), "draw long, columns binary, label int").orderBy("draw", "label", "columns").limit(limit).toArrow()
    columns = [np.frombuffer(x, dtype="<i4").astype(np.int64) for x in table.column("columns").to_pylist()]
    return fit(columns, np.array(table.column("label").to_pylist(), dtype=np.float64))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two numbers for each of 2**BITS columns
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, data, offsets in text_buffers(batch.column(1)):
                found = shared.value.probability(features(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(found)), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], [key, "score", "predicted"])

    return docs.select(key, text).mapInArrow(trimmed(run), f"`{key}` {kind}, score double, predicted int")


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
