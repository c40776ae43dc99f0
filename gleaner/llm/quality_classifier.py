"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Indicators of hashed byte n-grams of the lower-cased text are scaled by the class log-count ratios of naive Bayes,
brought to unit length, and a linear hinge-loss model is fitted on them by dual coordinate descent. Cross-fitted
margins calibrate a sigmoid, corrected for the share of classes among all labelled rows.

The log-count ratios cover every labelled training row and are summed on Spark. The descent runs on the driver over
about ``Settings.per_class`` rows of each class, drawn by hash: a bounded sample, whatever the input.
A model is two vectors of ``2 ** bits`` floats, so what is sent to the tasks doesn't grow with the data.

Defined results: null and empty texts have no n-gram and get the score of the bias; without a training row of each
class every score is the share of class 1 among the labelled rows (0.5 without any). Null labels are left out; of
several labels of one document the smallest counts; repeated documents count and are scored each on its own. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import per_batch, slices, small, texts, written


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    orders: tuple[int, ...] = (3, 4)
    per_class: int = 2048
    epochs: int = 12
    cost: float = 1.0
    smoothing: float = 1.0
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """margin = ratio-scaled unit indicators . weights + bias; probability = sigmoid(slope * margin + offset)."""

    settings: Settings
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, features: np.ndarray) -> float:
        ratios = self.ratios[features]
        norm = float(np.sqrt(ratios @ ratios))
        return self.bias + (float(ratios @ self.weights[features]) / norm if norm else 0.0)

    def probability(self, features: np.ndarray) -> float:
        return float(sigmoid(self.slope * self.margin(features) + self.offset))


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Indicators:
    """The sorted, distinct hashed n-grams of a text."""

    def __init__(self, settings: Settings) -> None:
        self.settings, self.seen = settings, np.zeros(1 << settings.bits, bool)

    def __call__(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
        for n in self.settings.orders:
            if raw.size < n:
                continue
            gram = np.full(raw.size - n + 1, n, np.uint32)
            for i in range(n):
                gram = gram * np.uint32(0x01000193) ^ raw[i:i + gram.size]
            self.seen[(gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.settings.bits)] = True
        found = np.flatnonzero(self.seen).astype(np.int32)
        self.seen[found] = False
        return found


def class_counts(labelled: DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """For each feature the labelled rows of class 0 and of class 1 that have it; the last entry counts rows."""
    size = 1 << settings.bits

    def run(batches):
        indicators, sums = Indicators(settings), np.zeros((2, size + 1), np.int64)
        for whole in batches:
            for batch in slices(whole):
                for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                    sums[label, indicators(text)] += 1
                    sums[label, size] += 1
        there = np.flatnonzero(sums.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(there.astype(np.int32)), pa.array(sums[0, there]), pa.array(sums[1, there])], names=["feature", "n0", "n1"])

    sums = (
        labelled.mapInArrow(run, "feature int, n0 long, n1 long").groupBy("feature")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    )
    n0, n1 = np.zeros(size + 1), np.zeros(size + 1)
    n0[sums.feature], n1[sums.feature] = sums.n0, sums.n1
    return n0, n1


def sample(labelled: DataFrame, rows: tuple[float, float], settings: Settings) -> tuple[list[np.ndarray], np.ndarray]:
    """About ``per_class`` rows of each class, as features: those whose hash lies below their share of ``rows``, the
    class sizes. No more than twice as many are ever collected, should one row be repeated that often."""
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        indicators = Indicators(settings)
        found = [indicators(text).tobytes() for text in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.binary())], names=["label", "features"])

    features, labels = [], []
    for label in (0, 1):
        share = min(1.0, settings.per_class / rows[label])
        drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))
        few = labelled.filter((F.col("label") == label) & drawn).select("label", "text")
        for row in per_batch(few, step, "label int, features binary").limit(2 * settings.per_class).collect():
            features.append(np.frombuffer(bytes(row.features), np.int32))
            labels.append(row.label)
    return features, np.array(labels, np.int64)


def descend(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, size: int, settings: Settings) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss: one dual variable a row, clipped to [0, cost]."""
    weights, bias, dual = np.zeros(size), 0.0, np.zeros(len(rows))
    random = np.random.default_rng(settings.seed)
    length = np.array([values @ values + 1.0 for _, values in rows])  # the bias is a feature of value 1
    for _ in range(settings.epochs):
        worst = 0.0
        for i in random.permutation(len(rows)).tolist():
            at, values = rows[i]
            gradient = signs[i] * (weights[at] @ values + bias) - 1.0
            new = min(max(dual[i] - gradient / length[i], 0.0), settings.cost)
            change = (new - dual[i]) * signs[i]
            if change:
                weights[at] += change * values
                bias += change
                dual[i] = new
                worst = max(worst, abs(change))
        if worst < 1e-3:
            break
    return weights, bias


def calibrated(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a sigmoid, by Newton steps on the ridge-regularised log loss with softened targets."""
    n1 = labels.sum()
    n0 = labels.size - n1
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(slope * margins + offset)
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([d @ margins + 1e-3 * slope, d.sum() + 1e-3 * offset])
        hessian = np.array([[h @ (margins * margins) + 1e-3, h @ margins], [h @ margins, h.sum() + 1e-3]])
        step = np.linalg.solve(hessian, gradient)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(slope), float(offset)


def labelled_rows(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality") -> DataFrame:
    """doc_id, text, label of the labelled rows for which ``train`` holds."""
    known = written(
        labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1))
        .groupBy("doc_id").agg(F.min("label").alias("label")), "labels")
    return texts(docs).filter(train).join(small(known), "doc_id")


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    size = 1 << settings.bits
    n0, n1 = class_counts(labelled, settings)
    rows0, rows1 = n0[size], n1[size]
    share = rows1 / (rows0 + rows1) if rows0 + rows1 else 0.5
    ratio = np.log((n1[:size] + settings.smoothing) / (n1[:size].sum() + settings.smoothing * size)
                   / ((n0[:size] + settings.smoothing) / (n0[:size].sum() + settings.smoothing * size)))
    if not rows0 or not rows1:
        constant = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return Model(settings, np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 0.0, float(constant))
    features, found = sample(labelled, (rows0, rows1), settings)
    rows = []
    for at in features:
        values = ratio[at]
        norm = np.sqrt(values @ values)
        rows.append((at, values / norm if norm else values))
    signs = 2.0 * found - 1
    margins, half = np.zeros(len(rows)), np.random.default_rng(settings.seed).permutation(len(rows)) % 2
    for part in (0, 1):
        inside = np.flatnonzero(half != part)
        weights, bias = descend([rows[i] for i in inside], signs[inside], size, settings)
        for i in np.flatnonzero(half == part):
            margins[i] = rows[i][1] @ weights[rows[i][0]] + bias
    slope, offset = calibrated(margins, found)
    weights, bias = descend(rows, signs, size, settings)
    drawn = found.sum() / max(1, (found == 0).sum())
    offset += float(np.log(rows1 / rows0) - np.log(drawn))
    return Model(settings, ratio.astype(np.float32), weights.astype(np.float32), float(bias), slope, offset)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, higher: class 1 likelier) and margin of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("margin", pa.float64())])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        indicators = Indicators(model.settings)
        margins = np.array([model.margin(indicators(text)) for text in batch.column("text").to_pylist()], np.float64)
        found = sigmoid(model.slope * margins + model.offset)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found), pa.array(margins)], schema=schema)

    return per_batch(texts(docs), step, "doc_id long, score double, margin double")


def kept_rows(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, as they are."""

    def score(column: pd.Series) -> pd.Series:
        indicators = Indicators(model.settings)
        return pd.Series([model.probability(indicators(text)) for text in column], dtype=float)

    return docs.filter(F.pandas_udf(score, "double")(F.coalesce("text", F.lit(""))) >= least)
