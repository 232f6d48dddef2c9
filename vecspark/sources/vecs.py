"""Readers of .fvecs and .ivecs files, and the deterministic vectors of the recall and quantisation workloads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_MASK = (1 << 64) - 1


def _read(spark: SparkSession, path: str, kind: str, element: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                words = np.frombuffer(content, "<i4")
                if not len(words):
                    continue
                width = int(words[0])
                if width <= 0 or len(words) % (width + 1):
                    raise ValueError(f"{name}: not a whole number of records of {width} values")
                table = words.reshape(-1, width + 1)
                if not (table[:, 0] == width).all():
                    raise ValueError(f"{name}: records differ in length")
                values = np.ascontiguousarray(table[:, 1:]).view(kind)
                for a in range(0, len(values), 10_000):
                    part = values[a : a + 10_000]
                    yield pd.DataFrame({"path": name, "row": np.arange(a, a + len(part)), "values": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, row bigint, values array<{element}>")


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, values): float vectors, numbered from 0 in each file. A file is read by one task."""
    return _read(spark, path, "<f4", "float")


def read_ivecs(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, values): integer vectors, such as true neighbours."""
    return _read(spark, path, "<i4", "int")


def sample(row: int, dimension: int) -> float:
    """A value in [-1, 1] from 64-bit wrapping integers."""
    v = (row * 0x9E3779B9 + dimension * 0x85EBCA6B) & _MASK
    v ^= v >> 16
    v = (v * 0x7FEB352D) & _MASK
    v ^= v >> 15
    return float(np.float32(np.float32(v & 0xFFFF) / np.float32(65535.0) * np.float32(2.0) - np.float32(1.0)))


def sample_rows(spark: SparkSession, rows: int, dimensions: int) -> DataFrame:
    """(row, embedding) of sample()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"row": batch["id"], "embedding": [[sample(int(r), d) for d in range(dimensions)] for r in batch["id"]]})

    return spark.range(rows).mapInPandas(run, "row bigint, embedding array<float>")


def sample_queries(queries: int, dimensions: int) -> list[list[float]]:
    """Each is a stored row, slightly shifted."""
    return [[float(np.float32(sample(q * 17 + 3, d) + 0.001)) for d in range(dimensions)] for q in range(queries)]
