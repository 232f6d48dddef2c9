"""Vector functions for SQL text. They are Arrow UDFs: a SQL function can't stand in ORDER BY."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vecspark.functions.distance import Metric

#: SQL name -> the metric whose index can answer it.
INDEXABLE = {"array_distance": Metric.EUCLIDEAN, "list_distance": Metric.EUCLIDEAN, "cosine_distance": Metric.COSINE, "inner_product": Metric.DOT, "dot_product": Metric.DOT}


def _rows(a: pd.Series) -> np.ndarray:
    return np.array([np.asarray(x, np.float64) for x in a]) if len(a) else np.zeros((0, 0))


def _each(compute):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        good = np.flatnonzero((a.notna() & b.notna()).to_numpy())
        if len(good):
            out[good] = compute(_rows(a.iloc[good]), _rows(b.iloc[good]))
        return pd.Series(out).where(a.notna().to_numpy() & b.notna().to_numpy())

    return run


def _l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(1))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(1)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.clip(1 - _product(a, b) / (np.sqrt(_product(a, a)) * np.sqrt(_product(b, b))), 0, 2)


FUNCTIONS = {"array_distance": _l2, "list_distance": _l2, "l2_distance": _l2, "cosine_distance": _cosine, "inner_product": _product, "dot_product": _product, "negative_inner_product": lambda a, b: -_product(a, b)}


def register(spark: SparkSession) -> None:
    for name, compute in FUNCTIONS.items():
        run = _each(compute)
        run.__name__ = name
        run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
        spark.udf.register(name, F.pandas_udf(run, "double"))
