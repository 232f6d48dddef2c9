"""Inverted file: k-means lists; a query reads the lists of its nearest centroids."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions.distance import Metric, pairwise, ranked, to_literal
from vecspark.operators import kmeans
from vecspark.operators.index import BATCH_SCHEMA, VectorIndex, nearest_of, need
from vecspark.sources.dataset import Dataset, matrix


@dataclass(frozen=True)
class IvfFlatConfig:
    partitions: int = 16
    probes: int = 4
    iterations: int = 12
    seed: int = 0x5EED
    #: What an empty cluster does: "reseed" with the farthest row, or "keep" its centroid.
    empty: str = "reseed"

    def check(self, rows: int) -> None:
        need(1 <= self.partitions <= rows, "as many partitions as rows at most, and one at least")
        need(1 <= self.probes <= self.partitions, "as many probes as partitions at most, and one at least")
        need(self.iterations > 0, "one training round at least")


def nearest_lists(metric: Metric, queries: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """Numbers of each query's nearest centroids, nearest first, ties to the smaller number."""
    d = pairwise(metric, queries, centroids)
    return np.lexsort((np.broadcast_to(np.arange(len(centroids)), d.shape), d), axis=1)[:, :probes]


def probe(postings: DataFrame, dimension: int, pairs: tuple[np.ndarray, ...], metric: Metric, k: int) -> DataFrame:
    """Each batch of the probed lists against the queries that probe its lists. pairs: qids, vectors, lists (q x probes)."""
    qids, vectors, lists = pairs
    wanted = sorted({int(x) for x in lists.ravel()})
    shared = postings.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, vectors, lists = shared.value
        for batch in batches:
            number = batch.column(0).to_numpy()
            rows, x = batch.column(1).to_numpy(), matrix(batch.column(2), dimension)
            for p in np.unique(number):
                who, here = np.flatnonzero((lists == p).any(1)), number == p
                for a in range(0, len(who), 256):
                    some = who[a : a + 256]
                    yield nearest_of(qids[some], rows[here], pairwise(metric, vectors[some], x[here]), k)

    return postings.where(F.col("partition").isin(wanted)).select("partition", "row", "embedding").mapInArrow(run, BATCH_SCHEMA)


class IvfFlatIndex(VectorIndex):
    """postings (partition, row, embedding) are kept by Spark, or, with a path, written there by list, so that probing a
    list is reading a directory."""

    kind = "ivf_flat"

    def __init__(self, dataset: Dataset, metric: Metric, config: IvfFlatConfig | None = None, path: str | None = None):
        super().__init__(dataset, metric)
        self.config = config or IvfFlatConfig()
        self.config.check(dataset.rows)
        self.centroids = kmeans.train(dataset, metric, self.config.partitions, self.config.iterations, self.config.seed, self.config.empty == "reseed")
        self.path = path
        self.postings = self._kept(kmeans.assigned(dataset, metric, self.centroids))

    def _kept(self, postings: DataFrame) -> DataFrame:
        if self.path is None:
            return postings.persist()
        postings.repartition("partition", F.pmod("row", F.lit(8))).write.mode("overwrite").partitionBy("partition").parquet(self.path)
        return self.dataset.spark.read.schema("row bigint, embedding array<float>, partition int").parquet(self.path)

    def save(self, path: str) -> None:
        """Lists by directory, centroids and settings: what open() needs."""
        self.postings.repartition("partition", F.pmod("row", F.lit(8))).write.partitionBy("partition").parquet(f"{path}/lists")
        self.centroid_table().coalesce(1).write.parquet(f"{path}/centroids")
        c = self.config
        settings = [(self.metric.value, c.partitions, c.probes, c.iterations, c.seed, c.empty)]
        self.dataset.spark.createDataFrame(settings, "metric string, partitions int, probes int, iterations int, seed bigint, empty string").coalesce(1).write.parquet(f"{path}/settings")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> IvfFlatIndex:
        """A saved index, without training; probes read its directories."""
        index = cls.__new__(cls)
        metric, *rest = spark.read.parquet(f"{path}/settings").first()
        index.config, index.metric, index.path = IvfFlatConfig(*rest), Metric(metric), f"{path}/lists"
        index.postings = spark.read.schema("row bigint, embedding array<float>, partition int").parquet(index.path)
        index.centroids = np.array([r[0] for r in spark.read.parquet(f"{path}/centroids").orderBy("partition").select("centroid").collect()], np.float32)
        index.dataset = Dataset(index.postings.select("row", "embedding"), index.centroids.shape[1], index.postings.count())
        return index

    def centroid_table(self) -> DataFrame:
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(self.centroids)]
        return self.dataset.spark.createDataFrame(rows, "partition int, centroid array<float>")

    def list_sizes(self) -> DataFrame:
        """(partition, rows) of every list, empty ones too."""
        every = self.dataset.spark.range(self.config.partitions).select(F.col("id").cast("int").alias("partition"))
        return every.join(self.postings.groupBy("partition").agg(F.count("*").alias("n")), "partition", "left").select("partition", F.coalesce("n", F.lit(0)).alias("rows"))

    def search(self, query: Sequence[float], k: int, probes: int | None = None) -> DataFrame:
        q = self.dataset.checked_query(query, self.metric)
        lists = nearest_lists(self.metric, q[None, :], self.centroids, self._probes(probes))[0]
        found = self.postings.where(F.col("partition").isin([int(x) for x in lists]))
        return found.select("row", ranked(to_literal(self.metric, F.col("embedding"), q)).alias("distance")).orderBy("distance", "row").limit(k)

    def search_batch(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        probes = self._probes(probes)
        return self._blocks(queries, k, lambda qids, vectors: probe(self.postings, self.dataset.dimension, (qids, vectors, nearest_lists(self.metric, vectors, self.centroids, probes)), self.metric, k))

    def _probes(self, probes: int | None) -> int:
        need(probes is None or 1 <= probes <= self.config.partitions, "as many probes as partitions at most, and one at least")
        return probes or self.config.probes

    def insert(self, rows: DataFrame) -> int:
        """Adds rows (row, embedding) to the lists of their nearest centroids; centroids stay. The number of rows."""
        new = Dataset.of(rows).require(self.metric)
        if new.dimension != self.dataset.dimension:
            self.dataset.checked_query([0.0] * new.dimension, Metric.EUCLIDEAN)
        extra = kmeans.assigned(new, self.metric, self.centroids)
        if self.path is None:
            old, self.postings = self.postings, self.postings.union(extra).persist()
            self.postings.count()
            old.unpersist()
        else:
            extra.write.mode("append").partitionBy("partition").parquet(self.path)
            self.postings = self.dataset.spark.read.schema("row bigint, embedding array<float>, partition int").parquet(self.path)
        self.dataset = Dataset(self.dataset.df.union(new.df), self.dataset.dimension, self.dataset.rows + new.rows)
        return new.rows

    def delete(self, rows: DataFrame) -> None:
        """Takes rows (row) out of the lists."""
        gone = rows.select(F.col("row").cast("bigint").alias("row")).distinct()
        self.postings = self.postings.join(gone, "row", "left_anti").select("partition", "row", "embedding")
        left = self.dataset.df.join(gone, "row", "left_anti").select("row", "embedding")
        self.dataset = Dataset(left, self.dataset.dimension, left.count())
