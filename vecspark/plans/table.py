"""Tables with an id, a payload and a vector column, and the indexes that can answer top-k queries on them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.errors import DuplicateId, InvalidConfig
from vecspark.functions.distance import Metric
from vecspark.operators.flat import FlatIndex
from vecspark.operators.graph import HnswConfig, HnswIndex, NswConfig, NswIndex
from vecspark.operators.index import VectorIndex
from vecspark.operators.ivf import IvfFlatConfig, IvfFlatIndex
from vecspark.operators.pq import IvfPqConfig, IvfPqIndex
from vecspark.sources.dataset import Dataset

ROW_SCHEMA = "id bigint not null, payload string not null, embedding array<float> not null"
#: Named rows (an id and a distance each) that are broadcast to find their table rows; more are joined by shuffling.
BROADCAST_ROWS = 100_000
#: What CREATE INDEX ... USING names, with its option names.
METHODS = {
    "flat": (FlatIndex, None, {}),
    "ivfflat": (IvfFlatIndex, IvfFlatConfig, {"lists": "partitions", "probe_lists": "probes"}),
    "ivf_pq": (IvfPqIndex, IvfPqConfig, {"lists": "partitions", "probe_lists": "probes"}),
    "nsw": (NswIndex, NswConfig, {"m": "max_connections"}),
    "hnsw": (HnswIndex, HnswConfig, {"m": "max_connections"}),
}
_OF_CONFIG = {IvfFlatConfig: IvfFlatIndex, IvfPqConfig: IvfPqIndex, NswConfig: NswIndex, HnswConfig: HnswIndex}


def build_index(dataset: Dataset, metric: Metric, config: object = None) -> VectorIndex:
    """The index that a configuration is of; without one, exact search."""
    if config is None:
        return FlatIndex(dataset, metric)
    return _OF_CONFIG[type(config)](dataset, metric, config)


class VectorTable:
    """base: any columns, among them `id` (unique, breaks ties) and `embedding`."""

    def __init__(self, base: DataFrame, metric: Metric | str = Metric.EUCLIDEAN, config: object = None, id_column: str = "id", embedding: str = "embedding"):
        self.id_column, self.embedding = id_column, embedding
        twice = base.groupBy(id_column).count().where("count > 1").agg(F.min(id_column)).first()[0]
        if twice is not None:
            raise DuplicateId(twice)
        self.base = base
        self.dataset = Dataset.of(base, id_column, embedding)
        self.metric = Metric.of(metric)
        self.indexes: dict[str, VectorIndex] = {}
        self.indexes["default"] = build_index(self.dataset, self.metric, config)

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Iterable[tuple[int, Sequence[float], str]], metric: Metric | str = Metric.EUCLIDEAN, config: object = None) -> VectorTable:
        """rows: (id, vector, payload)."""
        data = [(int(i), p, [float(x) for x in v]) for i, v, p in rows]
        seen: set[int] = set()
        for i, _, _ in data:  # before any vector is looked at
            if i in seen:
                raise DuplicateId(i)
            seen.add(i)
        return cls(spark.createDataFrame(data, ROW_SCHEMA), metric, config)

    @classmethod
    def empty_index(cls, base: DataFrame, id_column: str = "id", embedding: str = "embedding") -> VectorTable:
        """A table without any index yet: every query is exact until create_index()."""
        table = cls(base, Metric.EUCLIDEAN, None, id_column, embedding)
        table.indexes.clear()
        return table

    @property
    def spark(self) -> SparkSession:
        return self.base.sparkSession

    @property
    def index_kind(self) -> str:
        return next(iter(self.indexes.values())).kind

    def create_index(self, name: str, method: str, operator_class: str = "vector_l2_ops", **options: int) -> None:
        """CREATE INDEX name ON ... USING method (embedding operator_class) WITH (options)."""
        if method not in METHODS:
            raise InvalidConfig(f"unknown index method {method}")
        if name in self.indexes:
            raise InvalidConfig(f"index {name} exists")
        kind, config, renamed = METHODS[method]
        metric = Metric.of(operator_class)
        if config is None:
            self.indexes[name] = kind(self.dataset, metric)
        else:
            self.indexes[name] = kind(self.dataset, metric, config(**{renamed.get(k, k): v for k, v in options.items()}))

    def drop_index(self, name: str) -> None:
        del self.indexes[name]

    def choose(self, metric: Metric, method: str = "") -> tuple[str, VectorIndex] | None:
        """The first index of this metric, of the asked method if there is one; None for the method `none`."""
        if method == "none":
            return None
        wanted = {"ivfflat": "ivf_flat"}.get(method, method)
        return next(((n, x) for n, x in self.indexes.items() if x.metric is metric and (not wanted or x.kind == wanted)), None)

    def top_k(self, query: Sequence[float], k: int, **options: int) -> DataFrame:
        """The k nearest rows with all columns and their distance, nearest first, by the first index."""
        index = next(iter(self.indexes.values()), None) or FlatIndex(self.dataset, self.metric)
        return self.gather(index.search(query, k, **options), k).orderBy("distance", self.id_column)

    def knn_join(self, queries: DataFrame, k: int, **options: int) -> DataFrame:
        """queries (qid, embedding) -> (qid, row, distance, rank) by the first index."""
        index = next(iter(self.indexes.values()), None) or FlatIndex(self.dataset, self.metric)
        return index.search_batch(queries, k, **options)

    def filtered_top_k(self, query: Sequence[float], k: int, condition: Column | str, **options: int) -> DataFrame:
        """The k nearest of the rows that a condition holds for, with all columns and their distance, by the first index.

        The index names four times as many candidates from pass to pass until k of them fit. Where it has named all that
        it would, or a quarter of the table, exact search over the fitting rows answers, so none are missing.
        """
        condition = F.expr(condition) if isinstance(condition, str) else condition
        index, asked = next(iter(self.indexes.values()), None), 4 * k
        while index is not None and index.kind != "flat" and asked * 4 <= self.dataset.rows:
            near = index.search(query, asked, **options).persist()
            rows = self.gather(near, asked).where(condition).orderBy("distance", self.id_column).limit(k)
            if rows.count() >= k:
                return rows
            if near.count() < asked:
                break
            asked *= 4
        fits = self.base.where(condition)
        some = Dataset(fits.select(F.col(self.id_column).cast("bigint").alias("row"), F.col(self.embedding).cast("array<float>").alias("embedding")), self.dataset.dimension, self.dataset.rows)
        found = FlatIndex(some, index.metric if index else self.metric).search(query, k)
        return self.gather(found, k).orderBy("distance", self.id_column)

    def gather(self, found: DataFrame, k: int) -> DataFrame:
        """The rows that a search named, with `distance`. k bounds them: up to BROADCAST_ROWS they go to every task."""
        small = found.withColumnRenamed("row", "_row")
        small = F.broadcast(small) if k <= BROADCAST_ROWS else small
        return self.base.join(small, self.base[self.id_column] == F.col("_row")).drop("_row")

    def delete(self, condition: Column | str) -> int:
        """Takes the rows that a condition holds for out of the table and of every index. The number of rows."""
        condition = F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))
        gone = self.base.where(condition).select(F.col(self.id_column).cast("bigint").alias("row")).persist()
        n = gone.count()
        if n:
            self.base = self.base.where(~condition)
            self.dataset = Dataset(self.dataset.df.join(gone, "row", "left_anti"), self.dataset.dimension, self.dataset.rows - n)
            for name, index in self.indexes.items():
                if hasattr(index, "delete"):
                    index.delete(gone)
                else:
                    config = getattr(index, "config", None)
                    self.indexes[name] = type(index)(self.dataset, index.metric, *([config] if config else []))
        return n

    def update(self, values: dict[str, Column | str], condition: Column | str) -> int:
        """Sets columns of the rows that a condition holds for; in indexes they are deleted and inserted. The number of rows."""
        condition = F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))
        given = {c: F.expr(v) if isinstance(v, str) else v for c, v in values.items()}
        kind = dict(zip(self.base.columns, (f.dataType for f in self.base.schema), strict=True))
        changed = self.base.where(condition).select(*[given[c].cast(kind[c]).alias(c) if c in given else F.col(c) for c in self.base.columns])
        n = self.delete(condition)
        return self.insert(changed) if n else 0

    def insert(self, rows: DataFrame) -> int:
        """Appends rows and adds them to every index; centroids and graphs that are there stay. The number of rows."""
        rows = rows.select(*self.base.columns)
        again = self.base.select(self.id_column).join(rows.select(self.id_column), self.id_column).agg(F.min(self.id_column)).first()[0]
        if again is not None:
            raise DuplicateId(again)
        new = rows.select(F.col(self.id_column).alias("row"), F.col(self.embedding).alias("embedding"))
        n = Dataset.of(new).rows
        self.base = self.base.union(rows)
        self.dataset = Dataset(self.dataset.df.union(new.select(F.col("row").cast("bigint"), F.col("embedding").cast("array<float>"))), self.dataset.dimension, self.dataset.rows + n)
        for name, index in self.indexes.items():
            if hasattr(index, "insert"):
                index.insert(new)
            else:
                config = getattr(index, "config", None)
                self.indexes[name] = type(index)(self.dataset, index.metric, *([config] if config else []))
        return n
