"""Online insert: new vectors are assigned to the lists of a trained inverted file as they arrive."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecspark.functions.distance import Metric
from vecspark.operators import kmeans
from vecspark.sources.dataset import Dataset

POSTINGS = "row bigint, embedding array<float>, partition int"


def assign(batch: DataFrame, metric: Metric, centroids: np.ndarray) -> DataFrame:
    """(partition, row, embedding) of a batch (row, embedding); it is validated as a data set is."""
    return kmeans.assigned(Dataset.of(batch).require(metric), metric, centroids)


def stream_into(stream: DataFrame, metric: Metric, centroids: np.ndarray, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a stream (row, embedding) to postings at path, by list.

    A batch is written under its own number and replaces what an interrupted attempt of the same batch left, so each row
    arrives once however often a batch is tried.
    """

    def write(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        out = assign(batch.select("row", "embedding"), metric, centroids)
        out.write.mode("overwrite").partitionBy("partition").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """(partition, row, embedding) that streams have written; a filter on partition reads those lists alone."""
    return spark.read.schema(f"{POSTINGS}, batch bigint").option("basePath", path).parquet(path).select("partition", "row", "embedding")


def save_centroids(spark: SparkSession, centroids: np.ndarray, path: str) -> None:
    spark.createDataFrame([(i, json.dumps([float(x) for x in c])) for i, c in enumerate(centroids)], "partition int, centroid string").coalesce(1).write.mode("overwrite").parquet(path)


def load_centroids(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([json.loads(r["centroid"]) for r in spark.read.parquet(path).orderBy(F.col("partition")).collect()], np.float32)
