"""Softmax regression by full-batch, sliced and one-by-one gradient ascent on sparse features.

Rows are (doc_id, idx, val, label), a row a document. Weights are a small dense array on the driver; each step is one pass in which
tasks add up the gradient of their rows, summed by feature and class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

RATE, PENALTY, ERROR, ITERATIONS = 2e-7, 1.0, 1e-9, 2000


def rows_of(features: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, idx, val, label)`` of ``features(doc_id, idx, val)`` and ``labels(doc_id, label)``, classes from 0."""
    packed = F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("i"), F.col("val").cast("double").alias("v"))))
    grouped = features.groupBy("doc_id").agg(packed.alias("e")).select("doc_id", F.col("e.i").alias("idx"), F.col("e.v").alias("val"))
    return grouped.join(labels.select("doc_id", F.col("label").cast("int").alias("label")), "doc_id")


def _csr(batch: pa.RecordBatch):
    idx, val = batch.column("idx"), batch.column("val")
    offsets = idx.offsets.to_numpy() - idx.offsets[0].as_py()
    return idx.flatten().to_numpy(), val.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), np.diff(offsets))


def _probabilities(idx, val, row, n, w):
    scores = np.stack([np.bincount(row, val * w[idx, c], n) for c in range(w.shape[1])], axis=1)
    scores -= scores.max(axis=1, keepdims=True)
    p = np.exp(scores)
    return p / p.sum(axis=1, keepdims=True)


def _gradient(idx, val, row, labels, w):
    p = _probabilities(idx, val, row, len(labels), w)
    left = -p
    left[np.arange(len(labels)), labels] += 1
    g = np.stack([np.bincount(idx, val * left[row, c], len(w)) for c in range(w.shape[1])], axis=1)
    return g, float(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300)).sum())


def gradient(rows: DataFrame, w: np.ndarray) -> tuple[np.ndarray, float]:
    """Sum over all rows of x * (y - p) by feature and class, and of ln p of the labels."""
    shipped = rows.sparkSession.sparkContext.broadcast(w)  # features times classes
    classes = w.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, total, likelihood = shipped.value, np.zeros_like(shipped.value), 0.0
        for batch in batches:
            if batch.num_rows:
                g, l = _gradient(*_csr(batch), batch.column("label").to_numpy(), weights)
                total += g
                likelihood += l
        used = np.flatnonzero(np.abs(total).sum(axis=1))
        cell = np.r_[(used[:, None] * classes + np.arange(classes)).ravel(), -1]
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(np.r_[total[used].ravel(), likelihood])], names=["cell", "g"])

    summed = rows.select("idx", "val", "label").mapInArrow(run, "cell long, g double").groupBy("cell").agg(F.sum("g").alias("g")).toArrow()
    cell, g = summed.column("cell").to_numpy(), summed.column("g").to_numpy()
    out = np.zeros(w.size)
    out[cell[cell >= 0]] = g[cell >= 0]
    return out.reshape(w.shape), float(g[cell < 0].sum())


def objective(likelihood: float, w: np.ndarray, penalty: float = PENALTY, *, as_written: bool = False) -> float:
    """ln-likelihood minus penalty / 2 times the squared weights; ``as_written`` has no penalty, its integer half being 0."""
    return likelihood - (0.0 if as_written else penalty / 2 * float((w * w).sum()))


def fit(rows: DataFrame, features: int, classes: int, *, rate: float = RATE, penalty: float = PENALTY, iterations: int = ITERATIONS, error: float | None = ERROR, as_written: bool = False) -> np.ndarray:
    """Weights from 0 by full-batch ascent: w += rate * (gradient - penalty * w), until the objective's change relative to its first change is below ``error``; None runs all iterations."""
    rows = cut(rows, "softmax")
    w = np.zeros((features, classes))
    first = last = None
    for _ in range(iterations):
        g, likelihood = gradient(rows, w)
        now = objective(likelihood, w, penalty, as_written=as_written)
        if error is not None:
            if first is not None and last is not None and now != first and abs((now - last) / (now - first)) < error:
                break
            first = now if first is None else first
            last = now
        w = w + rate * (g - penalty * w)
    return w


def fit_slices(rows: DataFrame, position: Column, size: int, count: int, features: int, classes: int, *, rate: float = RATE, penalty: float = PENALTY, epochs: int = 1) -> np.ndarray:
    """Mini-batches: slice s holds the rows whose ``position`` is in s * size to (s + 1) * size - 1; each slice's gradient is one distributed pass."""
    rows = cut(rows.withColumn("__slice", F.floor(position / size).cast("int")), "softmax")
    w = np.zeros((features, classes))
    for _ in range(epochs):
        for s in range(-(-count // size)):
            g, _ = gradient(rows.filter(F.col("__slice") == s), w)
            w = w + rate * (g - penalty * w)
    return w


def fit_one_by_one(rows: DataFrame, features: int, classes: int, *, rate: float = RATE, penalty: float = PENALTY) -> np.ndarray:
    """One row at a time in doc_id order. The method is sequential, so one task streams over the sorted rows; it holds one batch and the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((features, classes))
        for batch in batches:
            idx, val, row = _csr(batch)
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            labels = batch.column("label").to_numpy()
            for k in range(batch.num_rows):
                i, x = idx[bounds[k] : bounds[k + 1]], val[bounds[k] : bounds[k + 1]]
                scores = x @ w[i]
                p = np.exp(scores - scores.max())
                left = -p / p.sum()
                left[labels[k]] += 1
                w *= 1 - rate * penalty
                w[i] += rate * x[:, None] * left
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(w.size)), pa.array(w.ravel())], names=["cell", "w"])

    ordered = rows.select("doc_id", "idx", "val", "label").repartition(1).sortWithinPartitions("doc_id")
    result = ordered.select("idx", "val", "label").mapInArrow(run, "cell long, w double").toArrow()
    w = np.zeros(features * classes)
    w[result.column("cell").to_numpy()] = result.column("w").to_numpy()
    return w.reshape(features, classes)


def predict(rows: DataFrame, w: np.ndarray, *, first_class: int = 0) -> DataFrame:
    """``(doc_id, hard, soft)``: the most likely class (ties: the smaller) and the expected one, counted from ``first_class``."""
    shipped = rows.sparkSession.sparkContext.broadcast(w)  # features times classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = _probabilities(*_csr(batch), batch.num_rows, shipped.value)
                hard = np.round(p, 12).argmax(axis=1) + first_class
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hard.astype(np.int32)), pa.array(p @ (np.arange(p.shape[1]) + first_class))], names=["doc_id", "hard", "soft"])

    return rows.select("doc_id", "idx", "val").mapInArrow(run, "doc_id long, hard int, soft double")


def weights_table(spark, w: np.ndarray) -> DataFrame:
    """``(idx, class, w)`` of weights."""
    idx, cls = np.indices(w.shape)
    return spark.createDataFrame(pa.table({"idx": idx.ravel().astype(np.int32), "class": cls.ravel().astype(np.int32), "w": w.ravel()}))
