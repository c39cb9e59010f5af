"""Quality classifier: support vectors on naive Bayes features.

A text's features are indicators of its hashed byte n-grams (one to four bytes). Each is scaled by the log
of the ratio of the classes' smoothed counts, the vector is normalised, and a linear hinge-loss model is
fitted by dual coordinate descent. A logistic curve, fitted on rows that the model has not seen and weighted
to the labels' proportions, turns margins into scores.

The classifier is fitted on a bounded sample (``SAMPLE_PER_CLASS`` labelled documents of each class, those
whose ids hash lowest); scoring covers every whole text.

Defined results: a null text scores as an empty one; a label given for an id more than once counts once (the
smaller); with labels of one class only, or none, every score is that class, or 0.5; repeated rows give
repeated rows; other columns are kept by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of_id, map_arrow, reader, text_chunks

BITS = 16
FEATURES = 1 << BITS
SAMPLE_PER_CLASS = 2_500
STEP = 1 << 20
THRESHOLD = 0.7


def indicators(text: bytes) -> np.ndarray:
    """The hashed n-grams that occur in a whole text, ascending; made in steps of bounded size."""
    seen = np.zeros(FEATURES, bool)
    for start in range(0, len(text), STEP):
        b = np.frombuffer(text[max(0, start - 3) : start + STEP], np.uint8).astype(np.uint32)
        codes = b
        seen[b * np.uint32(2654435761) >> np.uint32(32 - BITS)] = True
        for order in (2, 3, 4):
            if len(b) < order:
                break
            codes = codes[:-1] << np.uint32(8) | b[order - 1 :]
            seen[(codes ^ np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435761) >> np.uint32(32 - BITS)] = True
    return np.flatnonzero(seen)


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) that minimise |w|^2 / 2 + sum of cost * hinge; rows are (indices, values)."""
    w = np.zeros(FEATURES + 1)
    alpha = np.zeros(len(rows))
    norm = np.array([v @ v + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            gradient = y[i] * (w[at] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                w[-1] += step
                moved = max(moved, abs(new - alpha[i]) * norm[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float
    constant: float | None = None

    def vector(self, at: np.ndarray) -> np.ndarray:
        v = self.ratio[at]
        return v / max(float(np.sqrt(v @ v)), 1e-12)

    def margin(self, at: np.ndarray) -> float:
        return float(self.weights[at] @ self.vector(at)) + float(self.weights[-1])

    def score(self, text: bytes) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(indicators(text)) + self.offset, -30, 30))))


def _logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by damped Newton steps, with smoothed targets."""
    target = np.where(y > 0, (1 + (y > 0).sum()) / (2 + (y > 0).sum()), 1 / (2 + (y < 0).sum()))
    x, p = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        hessian = (x * (weight * q * (1 - q) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (weight * (q - target)) + 1e-3 * (p - [1.0, 0.0]))
        p = p - step * min(1.0, 4 / max(1e-12, float(np.abs(step).max())))
    return max(float(p[0]), 1e-3), float(p[1])


def _fit_margin(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """The classes' log-count ratios of these rows, and the hinge-loss weights on them."""
    counts = np.ones((2, FEATURES))
    for at, sign in zip(rows, y, strict=True):
        counts[int(sign > 0), at] += 1
    counts /= counts.sum(1, keepdims=True)
    shape = Model(np.log(counts[1] / counts[0]), np.zeros(1), 1.0, 0.0)
    weights = dual_coordinate_descent([(at, shape.vector(at)) for at in rows], y, np.full(len(y), 4.0))
    return Model(shape.ratio, weights, 1.0, 0.0)


def fit_indicators(rows: list[np.ndarray], label: np.ndarray, share: float) -> Model:
    """Fit on indicators with labels 0 and 1; ``share`` is that of label 1 among all labels."""
    if not len(rows) or len(set(label.tolist())) < 2:
        return Model(np.zeros(FEATURES), np.zeros(FEATURES + 1), 1.0, 0.0, float(label[0]) if len(rows) else 0.5)
    y = np.where(label > 0, 1.0, -1.0)
    prior = np.where(y > 0, share / max((y > 0).mean(), 1e-9), (1 - share) / max((y < 0).mean(), 1e-9))
    # Margins of rows whose labels neither the ratios nor the weights have seen, from three folds.
    fold, margin = np.arange(len(y)) % 3, np.zeros(len(y))
    for k in range(3):
        own = np.flatnonzero(fold != k)
        part = _fit_margin([rows[i] for i in own], y[own])
        for i in np.flatnonzero(fold == k):
            margin[i] = part.margin(rows[i])
    whole = _fit_margin(rows, y)
    return Model(whole.ratio, whole.weights, *_logistic(margin, y, prior))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on a sample of the labelled documents."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.min(label_col).alias("_label"))
    sizes = {int(r[0]): r[1] for r in known.groupBy("_label").count().collect()}
    order = F.xxhash64(F.col(id_col).cast("string"))
    picked = [known.where(F.col("_label") == k).orderBy(order, id_col).limit(SAMPLE_PER_CLASS) for k in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * SAMPLE_PER_CLASS rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch, "text"):
                at = [indicators(t or b"").astype("<u2").tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("_order"), part.column("_label"), pa.array(at, pa.binary())], names=["_order", "_label", "at"])

    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(sample, id_col)
    rows = rows.select(order.alias("_order"), F.col("_label").cast("int").alias("_label"), "text")
    found = sorted((r["_order"], r["_label"], bytes(r["at"])) for r in map_arrow(rows, count, "_order long, _label int, at binary").collect())
    label = np.array([r[1] for r in found], int)
    return fit_indicators([np.frombuffer(r[2], "<u2").astype(np.int64) for r in found], label, sizes.get(1, 0) / max(1, sum(sizes.values())))


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` but the text, with ``score`` double. No shuffle."""
    held = df.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in df.schema.fields if f.name not in (text_col, "score")]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for part, texts in text_chunks(batch, text_col):
                new = pa.array([model.score(t or b"") for t in texts], pa.float64())
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], new], names=[*[f.name for f in kept], "score"])

    return map_arrow(df, run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc_of_id(id_col) % 4 == 2, F.lit(False))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = reader(spark, sf_dir, "documents"), reader(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out()))
    out = score(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
