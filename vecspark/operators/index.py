"""What all indexes share: one interface, one result schema, and batches of queries against distributed rows."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.errors import DimensionMismatch, InvalidConfig, NonFiniteValue, ZeroNorm
from vecspark.functions.distance import Metric, pairwise
from vecspark.sources.dataset import Dataset, matrix

BATCH_SCHEMA = "qid bigint, row bigint, distance float"
#: Queries that one pass over the rows answers; they are sent to every task, so their size is bounded by this.
QUERY_BLOCK = 4096


def query_blocks(queries: DataFrame, dataset: Dataset, metric: Metric, block: int = QUERY_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(qids, vectors) of checked queries; the driver holds one block at a time."""

    def checked(qids: list[int], rows: list) -> tuple[np.ndarray, np.ndarray]:
        for q, v in zip(qids, rows, strict=True):
            if len(v) != dataset.dimension:
                raise DimensionMismatch(dataset.dimension, len(v))
            if not np.isfinite(np.asarray(v, np.float64).astype(np.float32)).all():
                raise NonFiniteValue(q, int(np.flatnonzero(~np.isfinite(np.asarray(v, np.float64).astype(np.float32)))[0]))
            if metric is Metric.COSINE and not np.any(v):
                raise ZeroNorm(q)
        return np.array(qids, np.int64), np.array(rows, np.float32).reshape(len(rows), dataset.dimension)

    qids, rows = [], []
    for r in queries.select(F.col("qid").cast("bigint"), F.col("embedding").cast("array<float>")).toLocalIterator():
        qids.append(r[0])
        rows.append(r[1])
        if len(rows) == block:
            yield checked(qids, rows)
            qids, rows = [], []
    if rows:
        yield checked(qids, rows)


def nearest_of(qids: np.ndarray, rows: np.ndarray, distance: np.ndarray, k: int) -> pa.RecordBatch:
    """The k nearest rows of each line of distance, ties to the smaller row. NaN is no candidate."""
    keep = min(k, len(rows))
    order = np.argsort(rows, kind="stable")
    distance, rows = distance[:, order], rows[order]
    if keep < len(rows):
        # everything up to the k-th distance, then the exact order among it
        kth = np.partition(distance, keep - 1, axis=1)[:, keep - 1 : keep] if keep else np.full((len(qids), 1), -np.inf)
        who, at = np.nonzero(distance <= np.where(np.isnan(kth), np.inf, kth))
    else:
        who, at = np.nonzero(~np.isnan(distance))
    sort = np.lexsort((at, distance[who, at], who))
    who, at = who[sort], at[sort]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    who, at = who[rank < keep], at[rank < keep]
    return pa.RecordBatch.from_arrays([pa.array(qids[who]), pa.array(rows[at]), pa.array(distance[who, at])], ["qid", "row", "distance"])


def scan(df: DataFrame, dimension: int, qids: np.ndarray, vectors: np.ndarray, k: int, metric: Metric) -> DataFrame:
    """Each query's k nearest of every Arrow batch of df (row, embedding): what is left for the final ranking."""
    shared = df.sparkSession.sparkContext.broadcast((qids, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, vectors = shared.value
        for batch in batches:
            rows, x = batch.column(0).to_numpy(), matrix(batch.column(1), dimension)
            for a in range(0, len(qids), 256):
                yield nearest_of(qids[a : a + 256], rows, pairwise(metric, vectors[a : a + 256], x), k)

    return df.select("row", "embedding").mapInArrow(run, BATCH_SCHEMA)


def top(candidates: DataFrame, k: int) -> DataFrame:
    """(qid, row, distance, rank): the k nearest by distance and then row."""
    order = Window.partitionBy("qid").orderBy("distance", "row")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class VectorIndex(ABC):
    kind: str

    def __init__(self, dataset: Dataset, metric: Metric):
        self.dataset, self.metric = dataset.require(metric), metric

    @abstractmethod
    def search(self, query: Sequence[float], k: int) -> DataFrame:
        """(row, distance) of the k nearest, nearest first."""

    @abstractmethod
    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """queries (qid, embedding) -> (qid, row, distance, rank)."""

    def _blocks(self, queries: DataFrame, k: int, one: Callable[[np.ndarray, np.ndarray], DataFrame]) -> DataFrame:
        spark = self.dataset.spark
        out = None
        for qids, vectors in query_blocks(queries, self.dataset, self.metric):
            part = one(qids, vectors)
            out = part if out is None else out.union(part)
        return top(out if out is not None else spark.createDataFrame([], BATCH_SCHEMA), k)


def need(condition: bool, message: str) -> None:
    if not condition:
        raise InvalidConfig(message)
