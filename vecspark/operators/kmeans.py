"""k-means on vectors, shared by the inverted file and the product quantiser.

A round is one pass: tasks assign their rows and send sums, counts and a checksum of the assignment; the driver holds
centroids only. A round whose assignment repeats the last one's ends the training before its update.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions.distance import Metric, pairwise
from vecspark.sources.dataset import Dataset, matrix


def seed_rows(df: DataFrame, seed: int, n: int) -> DataFrame:
    """The n rows that come first by the digest of seed and row."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("row").cast("string"))), "row").limit(n)


def assign_rows(metric: Metric, centroids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, ties to the smaller number."""
    return np.argmin(pairwise(metric, centroids, x), axis=0)


def assigned(dataset: Dataset, metric: Metric, centroids: np.ndarray) -> DataFrame:
    """(partition, row, embedding)."""
    shared = dataset.spark.sparkContext.broadcast(centroids)
    dimension = dataset.dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            partition = assign_rows(metric, shared.value, matrix(batch.column(1), dimension)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(partition), batch.column(0), batch.column(1)], ["partition", "row", "embedding"])

    return dataset.df.mapInArrow(run, "partition int, row bigint, embedding array<float>")


@dataclass
class Round:
    counts: np.ndarray
    sums: np.ndarray
    first: np.ndarray
    checksum: int


def one_round(dataset: Dataset, metric: Metric, centroids: np.ndarray) -> Round:
    shared = dataset.spark.sparkContext.broadcast(centroids)
    dimension, n = dataset.dimension, len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, first, mark = np.zeros(n, np.int64), np.zeros((n, dimension)), np.full(n, np.iinfo(np.int64).max), np.uint64(0)
        for batch in batches:
            rows, x = batch.column(0).to_numpy(), matrix(batch.column(1), dimension)
            if not len(rows):
                continue
            p = assign_rows(metric, shared.value, x)
            counts += np.bincount(p, minlength=n)
            np.add.at(sums, p, x.astype(np.float64))
            np.minimum.at(first, p, rows)
            with np.errstate(over="ignore"):
                h = (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ((p.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
                h ^= h >> np.uint64(29)
                mark ^= np.bitwise_xor.reduce(h * np.uint64(0xBF58476D1CE4E5B9))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([*used, n], pa.int32()), pa.array([*counts[used], 0], pa.int64()), pa.array([*first[used], 0], pa.int64()), pa.array([*sums[used].tolist(), []], pa.list_(pa.float64())), pa.array([*(0 for _ in used), int(mark.view(np.int64))], pa.int64())], ["p", "n", "first", "sums", "mark"])

    # task sums meet in the JVM, component by component, so the driver gets a row for each centroid
    parts = dataset.df.mapInArrow(run, "p int, n bigint, first bigint, sums array<double>, mark bigint")
    total = F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(dimension)])
    out = Round(np.zeros(n, np.int64), np.zeros((n, dimension)), np.zeros(n, np.int64), 0)
    for r in parts.groupBy("p").agg(F.sum("n").alias("n"), F.min("first").alias("first"), total.alias("sums"), F.bit_xor("mark").alias("mark")).collect():
        if r["p"] == n:
            out.checksum = r["mark"]
        else:
            out.counts[r["p"]], out.first[r["p"]], out.sums[r["p"]] = r["n"], r["first"], r["sums"]
    return out


def farthest_row(dataset: Dataset, metric: Metric, centroids: np.ndarray) -> np.ndarray:
    """The vector whose nearest centroid is farthest, ties to the larger row."""
    shared = dataset.spark.sparkContext.broadcast(centroids)
    dimension = dataset.dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                least = pairwise(metric, shared.value, matrix(batch.column(1), dimension)).min(0)
                k = np.lexsort((batch.column(0).to_numpy(), least))[-1]
                yield pa.RecordBatch.from_arrays([pa.array([least[k]], pa.float32()), batch.column(0).slice(k, 1), batch.column(1).slice(k, 1)], ["d", "row", "embedding"])

    found = dataset.df.mapInArrow(run, "d float, row bigint, embedding array<float>").agg(F.max(F.struct("d", "row", "embedding")).alias("m")).first()
    return np.array(found["m"]["embedding"], np.float32)


def _vector(dataset: Dataset, row: int) -> np.ndarray:
    return np.array(dataset.df.where(F.col("row") == row).first()["embedding"], np.float32)


def train(dataset: Dataset, metric: Metric, partitions: int, iterations: int, seed: int, reseed: bool = True) -> np.ndarray:
    """Centroids, numbered as their seed rows come. reseed: empty ones take the row that is then farthest from all.

    Centroids change one after the other, so two empty ones take different rows. Cosine centroids are normalised; one
    whose mean has no norm takes its first row.
    """
    centroids = np.array([r["embedding"] for r in seed_rows(dataset.df, seed, partitions).collect()], np.float32)
    last = None
    for _ in range(iterations):
        got = one_round(dataset, metric, centroids)
        if got.checksum == last:
            break
        last = got.checksum
        centroids = centroids.copy()
        for p in range(partitions):
            if not got.counts[p]:
                if reseed:
                    centroids[p] = farthest_row(dataset, metric, centroids)
                continue
            mean = (got.sums[p] / got.counts[p]).astype(np.float32)
            if metric is Metric.COSINE:
                norm = np.sqrt((mean.astype(np.float64) ** 2).sum())
                if norm > 0:
                    mean = (mean.astype(np.float64) / norm).astype(np.float32)
                else:
                    mean = _vector(dataset, int(got.first[p]))
            centroids[p] = mean
    return centroids
