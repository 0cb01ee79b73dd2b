"""Helpers of the training-data operators: stored tables, text buffers, hashing, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintwise.session import stored_table

__all__ = ["components", "give_back", "logistic", "mix", "read_table", "slices", "stored_table", "text_buffer"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the shared tables, read by Spark's own reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and the rows' boundaries; null counts as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of at most ``most`` text bytes, or of one row."""
    for batch in batches:
        _, bounds = text_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1
            end = max(at + 1, min(end, batch.num_rows))
            yield batch.slice(at, end - at)
            at = end


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task and keeps what it once held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps its own accounts


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing rounds of splitmix64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def logistic(x: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic over x, which has so many rows of either label, by Newton steps
    with a small penalty."""
    weight = zeros + ones
    mean = (weight * x).sum() / weight.sum()
    scale = np.sqrt((weight * (x - mean) ** 2).sum() / weight.sum()) or 1.0
    z = np.stack([(x - mean) / scale, np.ones(len(x))], axis=1)
    beta, penalty = np.zeros(2), np.diag([1e-2, 1e-6]) + 1e-9
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -50, 50)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty,
                               z.T @ (ones - weight * p) - penalty @ beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1] - beta[0] * mean / scale)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable id of every id that has a link: columns ``id``, ``component``.

    Alternates hooking every id to the smallest neighbouring label with one step of pointer
    jumping, so a chain of n ids takes about log n rounds. Each round is a written table; the
    driver sees one number per round. A hub is a hot key only in aggregations that combine
    before they shuffle, and in joins that the optimizer may split.
    """
    spark = links.sparkSession
    edges = stored_table(
        links.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v"))).where("u <> v").distinct(), "edges")
    labels = stored_table(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label"))
                          .select(F.col("u").alias("id"), "label"), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("v"), F.col("label").alias("seen")), "v") \
            .groupBy(F.col("u").alias("id")).agg(F.min("seen").alias("seen"))
        hooked = labels.join(near, "id").select("id", F.least("label", "seen").alias("label"), F.col("label").alias("old"))
        jump = hooked.select(F.col("id").alias("label"), F.col("label").alias("far"))
        after = stored_table(hooked.join(jump, "label", "left").select(
            "id", F.least("label", F.coalesce("far", "label")).alias("label"), "old"), "labels")
        moved = after.where("label <> old").limit(1).count()
        labels = after.select("id", "label")
        if not moved:
            return labels.select("id", F.col("label").alias("component"))
