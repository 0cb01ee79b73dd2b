"""Quality classifier: a regularised quadratic discriminant over document statistics.

A document becomes transformed shares of its bytes and byte transitions. Both classes get a mean
and a covariance, shrunk towards the pooled covariance and a multiple of the unit matrix; a
document's evidence is the difference of log densities, each from a Mahalanobis distance by
the class's Cholesky factor, made once. As statistics are not normal, a logistic over that
difference, with slope and intercept fitted on the training rows, makes it a probability. The
model is made from sums of the features and of their products per class, and the logistic from
counts of differences, so learning reads every labelled row twice and the driver sees a few
thousand numbers.

Defined results: null and empty texts have all counts zero and are scored like any other.
Without any usable label the score is 0.5; with one class only, it is that class's 0 or 1.
Repeated rows are scored, and repeated labels learnt, row by row; labels other than 0 and 1 or
null are not learnt. Other columns of the documents pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.llm.common import logistic, slices, stored_table, text_buffer

#: Byte classes: lower-case, upper-case, digit, space, line end, sentence mark, other mark, high byte.
LOWER, UPPER, DIGIT, SPACE, LINE, MARK, SYMBOL, HIGH = range(8)


def byte_classes() -> np.ndarray:
    table = np.full(256, SYMBOL, np.uint8)
    table[128:] = HIGH
    for first, last, kind in (("a", "z", LOWER), ("A", "Z", UPPER), ("0", "9", DIGIT)):
        table[ord(first):ord(last) + 1] = kind
    table[[0x20, 0x09]] = SPACE
    table[[0x0A, 0x0B, 0x0C, 0x0D]] = LINE
    for c in ".,;:?'\"-()":
        table[ord(c)] = MARK
    return table


CLASSES = byte_classes()
#: Transitions whose share is a feature of its own.
TURNS = ((UPPER, UPPER), (LOWER, SYMBOL), (UPPER, SYMBOL), (SYMBOL, SYMBOL), (SPACE, SYMBOL), (SYMBOL, SPACE),
         (SPACE, UPPER), (MARK, SYMBOL), (MARK, LINE))
#: Cells in which the differences of the training rows are counted.
CELLS, WIDEST = 4000, 50.0
N_FEATURES = 4 + 8 + len(TURNS)


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of N_FEATURES transformed statistics for each text of the buffer."""
    n = len(bounds) - 1
    size = np.diff(bounds).astype(float)
    kinds = CLASSES[data]
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(bounds))
    counts = np.bincount(doc * 8 + kinds, minlength=n * 8).reshape(n, 8).astype(float)
    if len(data) > 1:
        inside = doc[1:] == doc[:-1]
        turns = np.bincount((doc[1:] * 64 + kinds[:-1] * np.int64(8) + kinds[1:])[inside],
                            minlength=n * 64).reshape(n, 8, 8).astype(float)
    else:
        turns = np.zeros((n, 8, 8))
    gap = np.isin(np.arange(8), (SPACE, LINE))
    starts = turns[:, gap][:, :, ~gap].sum(axis=(1, 2)) + 1
    one = np.maximum(size, 1)
    share = np.sqrt(counts / one[:, None])
    letters = np.maximum(counts[:, LOWER] + counts[:, UPPER] + counts[:, HIGH], 1)
    out = [np.log1p(size), np.log1p(starts), np.log(one / starts),
           np.sqrt(counts[:, UPPER] / letters), *share.T]
    out += [np.sqrt(turns[:, a, b] / starts) for a, b in TURNS]
    return np.stack(out, axis=1)


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and its features."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values = features(*text_buffer(batch.column("text")))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), flat.cast(pa.list_(pa.float64()))],
                                             ["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        rows, "doc_id long, features array<double>")


@dataclass
class Discriminant:
    """Means, inverted Cholesky factors and constants of both classes; None where nothing was learnt."""

    means: np.ndarray | None
    factors: np.ndarray | None
    constants: np.ndarray | None
    fixed: float = 0.5
    slope: float = 1.0
    intercept: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, cut off where it says all."""
        density = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1)
                   for m, f, c in zip(self.means, self.factors, self.constants)]
        return np.clip(density[1] - density[0], -WIDEST, WIDEST)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.fixed)
        return 1 / (1 + np.exp(-(self.slope * self.difference(x) + self.intercept)))


def fit(labelled: DataFrame, shrink: float = 0.1, ridge: float = 0.02) -> Discriminant:
    """Learn from (features, label) rows; ``shrink`` goes to the pooled covariance, ``ridge`` to the unit."""
    d = N_FEATURES
    upper = np.triu_indices(d)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + len(upper[0])))
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = batch.column("label").to_numpy(zero_copy_only=False)
            for c in (0, 1):
                of = x[y == c]
                total[c] += np.concatenate([[len(of)], of.sum(axis=0), (of.T @ of)[upper]])
        k = total.shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], k).astype(np.int32)), pa.array(np.tile(np.arange(k), 2).astype(np.int32)),
             pa.array(total.ravel())], ["label", "part", "value"])

    training = labelled.where("label in (0, 1)").select("features", F.col("label").cast("int").alias("label"))
    rows = training.mapInArrow(sums, "label int, part int, value double").groupBy("label", "part").agg(F.sum("value")).collect()
    total = np.zeros((2, 1 + d + len(upper[0])))
    for c, k, v in rows:
        total[c, k] = v
    n = total[:, 0]
    if not n.all():
        return Discriminant(None, None, None, 0.5 if not n.any() else float(n[1] > 0))
    means = total[:, 1:1 + d] / n[:, None]
    spread = np.zeros((2, d, d))
    for c in (0, 1):
        spread[c][upper] = total[c, 1 + d:]
        spread[c] = spread[c] + np.triu(spread[c], 1).T - n[c] * np.outer(means[c], means[c])
    pooled = spread.sum(axis=0) / n.sum()
    unit = np.eye(d) * max(np.trace(pooled) / d, 1e-6)
    factors, constants = [], []
    for c in (0, 1):
        own = (1 - shrink) * spread[c] / n[c] + shrink * pooled
        root = np.linalg.cholesky((1 - ridge) * own + ridge * unit)
        factors.append(np.linalg.inv(root))
        constants.append(np.log(n[c] / n.sum()) - np.log(np.diag(root)).sum())
    model = Discriminant(means, np.stack(factors), np.array(constants))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, CELLS), np.int64)
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = batch.column("label").to_numpy(zero_copy_only=False)
            at = np.minimum((model.difference(x) + WIDEST) / (2 * WIDEST) * CELLS, CELLS - 1).astype(np.int64)
            for c in (0, 1):
                counts[c] += np.bincount(at[y == c], minlength=CELLS)
        some = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])],
                                         ["cell", "zeros", "ones"])

    seen = training.mapInArrow(cells, "cell long, zeros long, ones long").groupBy("cell").agg(
        F.sum("zeros"), F.sum("ones")).collect()
    cell, zeros, ones = np.array(seen, dtype=float).T
    model.slope, model.intercept = logistic((cell + 0.5) / CELLS * 2 * WIDEST - WIDEST, zeros, ones)
    return model


def learnt(docs_features: DataFrame, labels: DataFrame, held_out: str) -> Discriminant:
    """Fit on the labelled documents (labels: doc_id, label) for which ``held_out`` is not true."""
    known = labels.where("label is not null").where(f"not ({held_out})")
    return fit(docs_features.join(known, "doc_id"))


def scored(docs_features: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score of every row."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return docs_features.mapInArrow(rows, "doc_id long, score double")


def accepted(docs: DataFrame, model: Discriminant, least: float) -> DataFrame:
    """The documents, all columns as they are, whose score is at least ``least``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            score = model.score(features(*text_buffer(batch.column("text"))))
            yield batch.filter(pa.array(score >= least))

    return docs.mapInArrow(rows, docs.schema)


def stored_features(docs: DataFrame) -> DataFrame:
    return stored_table(with_features(docs), "features")
