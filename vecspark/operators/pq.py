"""Inverted file with product quantisation: codes of residuals rank a shortlist, exact distances rank the result."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.errors import InvalidConfig
from vecspark.functions.distance import Metric, pairwise
from vecspark.operators.index import BATCH_SCHEMA, VectorIndex, nearest_of, need
from vecspark.operators.ivf import IvfFlatConfig, IvfFlatIndex
from vecspark.sources.dataset import Dataset, matrix


@dataclass(frozen=True)
class IvfPqConfig:
    partitions: int = 16
    probes: int = 4
    iterations: int = 12
    subquantizers: int = 4
    codebook_size: int = 16
    rerank: int = 32
    seed: int = 0x5EED

    def check(self, rows: int, dimension: int, metric: Metric) -> None:
        need(metric is Metric.EUCLIDEAN, "product codes need Euclidean distance")
        need(1 <= self.partitions <= rows, "as many partitions as rows at most, and one at least")
        need(1 <= self.probes <= self.partitions, "as many probes as partitions at most, and one at least")
        need(self.iterations > 0, "one training round at least")
        need(self.subquantizers > 0 and dimension % self.subquantizers == 0, "slices must be of equal width: subquantizers has to divide the dimension")
        need(2 <= self.codebook_size <= min(256, rows), "2 to 256 codewords, no more than rows")
        need(self.rerank > 0, "rerank has to be positive")


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances in double, a line for each of a; differences first, so large magnitudes keep their order."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    return np.stack([np.einsum("ij,ij->i", y - one, y - one) for one in x]) if len(x) else np.zeros((0, len(y)))


#: Shortlisted rows that are sent to the vectors; more of them meet the vectors in a shuffle.
BROADCAST_ROWS = 500_000
UNREPRESENTABLE = "distances of results must be representable as float32"


class IvfPqIndex(VectorIndex):
    kind = "ivf_pq"

    def __init__(self, dataset: Dataset, metric: Metric, config: IvfPqConfig | None = None):
        self.config = config or IvfPqConfig()
        self.config.check(dataset.rows, dataset.dimension, metric)
        super().__init__(dataset, metric)
        c = self.config
        self.coarse = IvfFlatIndex(dataset, metric, IvfFlatConfig(c.partitions, c.probes, c.iterations, c.seed))
        self.centroids, self.width = self.coarse.centroids, dataset.dimension // c.subquantizers
        self.residuals = self._residuals().persist()
        bad = self.residuals.where("bad").agg(F.min("row")).first()[0]
        if bad is not None:
            raise InvalidConfig("residuals of the training rows exceed float32")
        self.codebooks = self._trained()
        if not np.isfinite(self.codebooks).all():
            raise InvalidConfig("codewords exceed float32")
        self.codes = self._encoded().persist()

    def _residuals(self) -> DataFrame:
        """(row, partition, residual, bad): of each row against its own nearest centroid by squared distance."""
        shared, dimension = self.dataset.spark.sparkContext.broadcast(self.centroids), self.dataset.dimension

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, centroids = matrix(batch.column(1), dimension), shared.value
                p = np.argmin(squared(centroids, x), axis=0)
                with np.errstate(over="ignore", invalid="ignore"):
                    rest = (x.astype(np.float64) - centroids[p].astype(np.float64)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.astype(np.int32)), pa.array(list(rest), pa.list_(pa.float32())), pa.array(~np.isfinite(rest).all(1))], ["row", "partition", "residual", "bad"])

        return self.dataset.df.mapInArrow(run, "row bigint, partition int, residual array<float>, bad boolean")

    def _trained(self) -> np.ndarray:
        """Codewords (slice, code, component): k-means in each slice, all slices in one pass a round; empty codes stay."""
        c, width, dimension = self.config, self.width, self.dataset.dimension
        books = np.zeros((c.subquantizers, c.codebook_size, width), np.float32)
        for m in range(c.subquantizers):
            key = F.md5(F.concat_ws(":", F.lit(str(c.seed)), F.lit(str(m)), F.col("row").cast("string")))
            part = F.slice("residual", m * width + 1, width)
            books[m] = [r[0] for r in self.residuals.select(part.alias("v"), key.alias("key"), "row").orderBy("key", "row").limit(c.codebook_size).select("v").collect()]
        last = [None] * c.subquantizers
        open_slices = set(range(c.subquantizers))
        for _ in range(c.iterations):
            shared = self.dataset.spark.sparkContext.broadcast(books)

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                books = shared.value
                counts, sums, marks = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape), np.zeros(len(books), np.uint64)
                for batch in batches:
                    rows, x = batch.column(0).to_numpy(), matrix(batch.column(1), dimension)
                    for m in range(len(books)):
                        part = x[:, m * width : (m + 1) * width]
                        code = np.argmin(squared(books[m], part), axis=0)
                        counts[m] += np.bincount(code, minlength=books.shape[1])
                        np.add.at(sums[m], code, part.astype(np.float64))
                        with np.errstate(over="ignore"):
                            h = (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ((code.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
                            marks[m] ^= np.bitwise_xor.reduce((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) if len(rows) else np.uint64(0)
                m, code = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(m, pa.int32()), pa.array(code, pa.int32()), pa.array(counts[m, code]), pa.array(list(sums[m, code]), pa.list_(pa.float64())), pa.array(np.zeros(len(m), np.int64))], ["m", "code", "n", "sums", "mark"])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(books)), pa.int32()), pa.array([-1] * len(books), pa.int32()), pa.array([0] * len(books), pa.int64()), pa.array([[]] * len(books), pa.list_(pa.float64())), pa.array(marks.view(np.int64))], ["m", "code", "n", "sums", "mark"])

            parts = self.residuals.select("row", "residual").mapInArrow(run, "m int, code int, n bigint, sums array<double>, mark bigint")
            total = F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)])
            got = parts.groupBy("m", "code").agg(F.sum("n").alias("n"), total.alias("sums"), F.bit_xor("mark").alias("mark")).collect()
            marks = {r["m"]: r["mark"] for r in got if r["code"] < 0}
            open_slices -= {m for m in open_slices if marks[m] == last[m]}
            if not open_slices:
                break
            books = books.copy()
            for r in got:
                if r["code"] >= 0 and r["m"] in open_slices:
                    books[r["m"], r["code"]] = (np.array(r["sums"]) / r["n"]).astype(np.float32)
            last = [marks[m] for m in range(c.subquantizers)]
        return books

    def _encoded(self) -> DataFrame:
        """(partition, row, codes)."""
        shared, width, dimension = self.dataset.spark.sparkContext.broadcast(self.codebooks), self.width, self.dataset.dimension

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = shared.value
            for batch in batches:
                x = matrix(batch.column(2), dimension)
                codes = np.stack([np.argmin(squared(books[m], x[:, m * width : (m + 1) * width]), axis=0) for m in range(len(books))], axis=1).astype(np.int16)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(codes), pa.list_(pa.int16()))], ["partition", "row", "codes"])

        return self.residuals.select("partition", "row", "residual").mapInArrow(run, "partition int, row bigint, codes array<smallint>")

    def codebook_table(self) -> DataFrame:
        rows = [(m, k, [float(x) for x in w]) for m, book in enumerate(self.codebooks) for k, w in enumerate(book)]
        return self.dataset.spark.createDataFrame(rows, "m int, code int, codeword array<float>")

    def list_sizes(self) -> DataFrame:
        every = self.dataset.spark.range(self.config.partitions).select(F.col("id").cast("int").alias("partition"))
        return every.join(self.codes.groupBy("partition").agg(F.count("*").alias("n")), "partition", "left").select("partition", F.coalesce("n", F.lit(0)).alias("rows"))

    def encoded_bytes(self) -> int:
        return self.dataset.rows * self.config.subquantizers

    def codebook_bytes(self) -> int:
        return self.codebooks.size * 4

    def full_precision_bytes(self) -> int:
        return self.dataset.rows * self.dataset.dimension * 4

    def compression(self) -> float:
        return self.full_precision_bytes() / (self.encoded_bytes() + self.codebook_bytes())

    def _checked(self, probes: int | None, rerank: int | None) -> tuple[int, int]:
        need(probes is None or 1 <= probes <= self.config.partitions, "as many probes as partitions at most, and one at least")
        need(rerank is None or rerank > 0, "rerank has to be positive")
        return probes or self.config.probes, rerank or self.config.rerank

    def _lists(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """Numbers of each query's nearest lists."""
        order = squared(vectors, self.centroids)
        return np.lexsort((np.broadcast_to(np.arange(order.shape[1]), order.shape), order), axis=1)[:, :probes]

    def shortlist(self, qids: np.ndarray, vectors: np.ndarray, size: int, probes: int) -> DataFrame:
        """(qid, row, approx): by the codes alone, the nearest of the probed lists. Tables are made for each batch's lists."""
        lists = self._lists(vectors, probes)
        shared = self.dataset.spark.sparkContext.broadcast((qids, vectors, lists, self.centroids, self.codebooks))
        width, m_count = self.width, self.config.subquantizers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, vectors, lists, centroids, books = shared.value
            for batch in batches:
                number, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                codes = matrix(batch.column(2), m_count)
                for p in np.unique(number):
                    here = np.flatnonzero(number == p)
                    here = here[np.argsort(rows[here], kind="stable")]
                    for i in np.flatnonzero((lists == p).any(1)):
                        rest = vectors[i].astype(np.float64) - centroids[p].astype(np.float64)
                        tables = np.stack([((rest[m * width : (m + 1) * width] - books[m].astype(np.float64)) ** 2).sum(1) for m in range(m_count)])
                        approx = tables[np.arange(m_count), codes[here]].sum(1)
                        best = np.argsort(approx, kind="stable")[:size]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), qids[i])), pa.array(rows[here[best]]), pa.array(approx[best])], ["qid", "row", "approx"])

        wanted = sorted({int(x) for x in lists.ravel()})
        found = self.codes.where(F.col("partition").isin(wanted)).mapInArrow(run, "qid bigint, row bigint, approx double")
        if size >= self.dataset.rows:
            return found
        rank = F.row_number().over(Window.partitionBy("qid").orderBy("approx", "row"))
        return found.withColumn("_rank", rank).where(F.col("_rank") <= size).drop("_rank")

    def _whole(self, qids: np.ndarray, vectors: np.ndarray, k: int, probes: int) -> DataFrame:
        """(qid, row, distance) where the shortlist is every row of the probed lists, so that codes needn't rank it: each
        batch of the lists is compared where it is and sends on k rows a query, not every pair."""
        lists = self._lists(vectors, probes)
        wanted = sorted({int(x) for x in lists.ravel()})
        shared, dimension, metric = self.dataset.spark.sparkContext.broadcast((qids, vectors, lists)), self.dataset.dimension, self.metric

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, vectors, lists = shared.value
            for batch in batches:
                number, rows, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), dimension)
                members = [(p, np.flatnonzero(number == p)) for p in np.unique(number)]
                for a in range(0, len(qids), 256):
                    distance = np.full((len(qids[a : a + 256]), len(rows)), np.nan, np.float32)
                    for p, here in members:
                        who = np.flatnonzero((lists[a : a + 256] == p).any(1))
                        if len(who):
                            distance[np.ix_(who, here)] = pairwise(metric, vectors[a + who], x[here])
                    yield nearest_of(qids[a : a + 256], rows, distance, k)

        listed = self.codes.where(F.col("partition").isin(wanted)).select("partition", "row")
        return self.dataset.df.join(listed, "row").select("partition", "row", "embedding").mapInArrow(run, BATCH_SCHEMA)

    def _ranked(self, qids: np.ndarray, vectors: np.ndarray, k: int, probes: int, rerank: int) -> DataFrame:
        """What the final ranking takes: exact distances of the shortlist, of a whole one those of each batch's nearest."""
        size = min(max(rerank, k), self.dataset.rows)
        if size == self.dataset.rows:
            return self._whole(qids, vectors, k, probes)
        short = self.shortlist(qids, vectors, size, probes)
        shared, dimension = self.dataset.spark.sparkContext.broadcast(dict(zip(qids.tolist(), vectors, strict=True))), self.dataset.dimension

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(2), dimension)
                q = np.array([shared.value[i] for i in batch.column(0).to_pylist()]).reshape(len(x), dimension)
                diff = x.astype(np.float64) - q.astype(np.float64)
                with np.errstate(over="ignore"):
                    d = np.sqrt(np.einsum("ij,ij->i", diff, diff)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], ["qid", "row", "distance"])

        if size * len(qids) <= BROADCAST_ROWS:  # the shortlists' bound: three numbers a row
            short = F.broadcast(short)
        joined = self.dataset.df.join(short, "row").select("qid", "row", "embedding")
        return joined.mapInArrow(run, "qid bigint, row bigint, distance float")

    def search(self, query: Sequence[float], k: int, probes: int | None = None, rerank: int | None = None) -> DataFrame:
        q = self.dataset.checked_query(query, self.metric)
        probes, rerank = self._checked(probes, rerank)
        found = self._ranked(np.zeros(1, np.int64), q[None, :], k, probes, rerank).select("row", "distance").persist()
        lost, n = found.agg(F.count(F.when(F.abs("distance") == float("inf"), 1)), F.count("*")).first()
        if lost and n - lost < min(k, n):
            raise InvalidConfig(UNREPRESENTABLE)
        return found.where(F.abs("distance") < float("inf")).orderBy("distance", "row").limit(k)

    def search_batch(self, queries: DataFrame, k: int, probes: int | None = None, rerank: int | None = None) -> DataFrame:
        """As search(): raises if a query gets fewer than its k rows because some of their distances aren't representable."""
        probes, rerank = self._checked(probes, rerank)

        def one(qids: np.ndarray, vectors: np.ndarray) -> DataFrame:
            found = self._ranked(qids, vectors, k, probes, rerank).persist()
            good = F.abs("distance") < float("inf")
            counts = found.groupBy("qid").agg(F.count("*").alias("n"), F.count(F.when(good, 1)).alias("good"))
            if not counts.where((F.col("good") < F.col("n")) & (F.col("good") < F.least(F.col("n"), F.lit(k)))).isEmpty():
                raise InvalidConfig(UNREPRESENTABLE)
            return found.where(good)

        return self._blocks(queries, k, one)
