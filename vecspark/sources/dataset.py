"""Validated vectors: a DataFrame (row, embedding) whose rows share one dimension and are finite.

`row` is the identity that breaks ties; any unique order-giving number will do, so an id needs no renumbering.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.errors import DimensionMismatch, EmptyDataset, EmptyVector, NonFiniteValue, ZeroNorm
from vecspark.functions.distance import Metric, squared_norm

SCHEMA = T.StructType([T.StructField("row", T.LongType(), False), T.StructField("embedding", T.ArrayType(T.FloatType(), False), False)])


def _bad_at(v: Column) -> Column:
    """Position of the first value that isn't finite, -1 if all are."""
    bad = F.transform(v, lambda x: F.coalesce(F.isnan(x) | (F.abs(x.cast("double")) == float("inf")), F.lit(True)))
    return (F.array_position(bad, True) - 1).cast("int")


class Dataset:
    def __init__(self, df: DataFrame, dimension: int, rows: int):
        self.df, self.dimension, self.rows = df, dimension, rows

    def __len__(self) -> int:
        return self.rows

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @classmethod
    def of(cls, df: DataFrame, row: str = "row", embedding: str = "embedding") -> Dataset:
        """Validates in one aggregate; only rejected data is read again, for the first row that is at fault."""
        df = df.select(F.col(row).cast("bigint").alias("row"), F.col(embedding).cast("array<float>").alias("embedding"))
        size = F.coalesce(F.size("embedding"), F.lit(0))
        bad = F.when(F.col("embedding").isNotNull(), _bad_at(F.col("embedding")))
        found = df.agg(F.count("*").alias("n"), F.min_by(size, "row").alias("first"), F.min(size).alias("low"), F.max(size).alias("high"), F.min(F.when(bad >= 0, F.col("row"))).alias("bad")).first()
        if not found["n"]:
            raise EmptyDataset
        if not found["first"] or found["first"] < 0:
            raise EmptyVector
        if found["low"] != found["high"] or found["bad"] is not None:
            fault = df.where((size != found["first"]) | (bad >= 0)).select("row", size.alias("size"), bad.alias("bad")).orderBy("row").first()
            if fault["size"] != found["first"]:
                raise DimensionMismatch(found["first"], fault["size"])
            raise NonFiniteValue(fault["row"], fault["bad"])
        return cls(df, found["first"], found["n"])

    @classmethod
    def from_vectors(cls, spark: SparkSession, vectors: Iterable[Sequence[float]]) -> Dataset:
        rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
        return cls.of(spark.createDataFrame(rows, SCHEMA))

    def require(self, metric: Metric) -> Dataset:
        """Cosine distance needs rows with a norm."""
        if metric is Metric.COSINE:
            zero = self.df.where(squared_norm(F.col("embedding")) == 0).agg(F.min("row")).first()[0]
            if zero is not None:
                raise ZeroNorm(zero)
        return self

    def checked_query(self, query: Sequence[float], metric: Metric) -> np.ndarray:
        """The query as float32; what is wrong with it is reported as of the row behind the last."""
        with np.errstate(over="ignore"):
            q = np.asarray(query, np.float64).astype(np.float32)
        if len(q) != self.dimension:
            raise DimensionMismatch(self.dimension, len(q))
        if not np.isfinite(q).all():
            raise NonFiniteValue(self.rows, int(np.flatnonzero(~np.isfinite(q))[0]))
        if metric is Metric.COSINE and not np.any(q.astype(np.float64) ** 2):
            raise ZeroNorm(self.rows)
        return q


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """A validated vector column of a batch as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimension) if len(column) else np.zeros((0, dimension), np.float32)
