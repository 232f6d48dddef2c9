"""Exact search: every row's distance, the k least by distance and row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions.distance import Metric, ranked, to_literal
from vecspark.operators.index import VectorIndex, scan
from vecspark.sources.dataset import Dataset


class FlatIndex(VectorIndex):
    kind = "flat"

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        """One scan with a bounded queue in each task; the sort and limit become a single top-k operator."""
        q = self.dataset.checked_query(query, self.metric)
        return self.dataset.df.select("row", ranked(to_literal(self.metric, F.col("embedding"), q)).alias("distance")).orderBy("distance", "row").limit(k)

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """One pass over the rows for each block of queries."""
        return self._blocks(queries, k, lambda qids, vectors: scan(self.dataset.df, self.dataset.dimension, qids, vectors, k, self.metric))


def exact_search(dataset: Dataset, metric: Metric, query: Sequence[float], k: int) -> DataFrame:
    return FlatIndex(dataset, metric).search(query, k)
