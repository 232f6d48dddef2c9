"""Distances: Column expressions that stay in the JVM, and their numpy twins for Arrow batches.

Sums are in double and the distance is rounded to float, which is what rankings compare. Smaller is nearer for all three
metrics: the inner product is negated.

Of parallel vectors the cosine distance is all rounding error, by which they are ranked all the same. So products are summed
from the first to the last component and divided by the root of both norms' product everywhere, as DuckDB does.
"""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Literal queries up to this width become one arithmetic expression in generated code; wider ones a higher-order function.
UNROLL = 256
#: Up to so many rows are summed by one running total; for more, a step for each component is faster. Both give the same sums.
FEW = 128


class Metric(Enum):
    EUCLIDEAN = "Euclidean"
    COSINE = "Cosine"
    DOT = "Dot"

    @classmethod
    def of(cls, name: str | Metric) -> Metric:
        if isinstance(name, Metric):
            return name
        known = {"l2": cls.EUCLIDEAN, "vector_l2_ops": cls.EUCLIDEAN, "vector_cosine_ops": cls.COSINE, "inner_product": cls.DOT, "vector_ip_ops": cls.DOT}
        return known.get(name.lower()) or next(m for m in cls if m.value.lower() == name.lower())


def _double(x: Column) -> Column:
    return x.cast("double")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + _double(x) * _double(x))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: _double(x) * _double(y)))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (_double(x) - _double(y)) * (_double(x) - _double(y))))


def normalized(v: Column) -> Column:
    """v at unit length, null if its norm is zero."""
    norm = F.sqrt(squared_norm(v))
    return F.when(norm > 0, F.transform(v, lambda x: (_double(x) / norm).cast("float")))


def exact(metric: Metric, a: Column, b: Column) -> Column:
    """Distance in double between two vector columns."""
    if metric is Metric.EUCLIDEAN:
        return F.sqrt(squared_l2(a, b))
    if metric is Metric.DOT:
        return -dot(a, b)
    cosine = dot(a, b) / F.sqrt(squared_norm(a) * squared_norm(b))
    return F.least(F.greatest(F.lit(1.0) - cosine, F.lit(0.0)), F.lit(2.0))


def to_literal(metric: Metric, v: Column, query: Sequence[float]) -> Column:
    """Distance in double to a literal; one generated expression if the query is not too wide."""
    q = np.asarray(query, np.float32).astype(np.float64)
    if len(q) > UNROLL:
        return exact(metric, v, F.array(*[F.lit(float(x)) for x in q]))

    def total(term) -> Column:
        out = F.lit(0.0)
        for i, x in enumerate(q):
            out = out + term(_double(F.get(v, F.lit(i))), float(x))
        return out

    if metric is Metric.EUCLIDEAN:
        return F.sqrt(total(lambda c, x: (c - x) * (c - x)))
    product = total(lambda c, x: c * x)
    if metric is Metric.DOT:
        return -product
    cosine = product / F.sqrt(total(lambda c, _: c * c) * F.lit(float(_sums(q, q[None, :])[0])))
    return F.least(F.greatest(F.lit(1.0) - cosine, F.lit(0.0)), F.lit(2.0))


def ranked(distance: Column) -> Column:
    """The distance that rankings compare."""
    return distance.cast("float")


def pairwise(metric: Metric, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distances as float32, a line for each query."""
    with np.errstate(over="ignore"):
        return pairwise_exact(metric, queries, rows).astype(np.float32)


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner product of each row of b with a or its row, summed from the first component to the last."""
    if len(b) <= FEW:
        return np.cumsum(a * b, axis=1)[:, -1]
    out, one = np.zeros(len(b)), np.empty(len(b))
    for j in range(b.shape[1]):
        out += np.multiply(a[..., j], b[:, j], out=one)
    return out


def pairwise_exact(metric: Metric, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    x, q = rows.astype(np.float64), queries.astype(np.float64)
    out = np.empty((len(q), len(x)))
    if metric is Metric.EUCLIDEAN:
        for i, one in enumerate(q):
            diff = x - one
            out[i] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        return out
    if len(x) > FEW:
        x = np.asfortranarray(x)
    for i, one in enumerate(q):
        out[i] = _sums(one, x)
    if metric is Metric.DOT:
        return -out
    norms = np.sqrt(_sums(x, x)[None, :] * _sums(q, q)[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.clip(1.0 - out / norms, 0.0, 2.0)
