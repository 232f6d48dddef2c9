"""Exact top-k inner products by block-at-a-time pruning.

Component x of a vector becomes the integer floor(64 * x). Candidates are dealt into shards by a hash of vec_id; in a
shard they are ordered so that like vectors stand together and cut into blocks, each with its forward index (its rows)
and the least and greatest value of every component. Of a query and a block, the sum over components of the greater of
q * greatest and q * least bounds every score in it. Each query takes a shard's blocks in the order of that bound and
stops at the first that falls below its k-th score so far (scores are exact in float64 below 2**53; beyond, Python's
integers compare every row); a block whose bound equals it is still read, since a tie goes
to the smaller vec_id. The best of all shards meet in one ranking per query.

Defined cases: null vectors and vectors with null or non-finite components take no part (products of 64 * x beyond 64 bits saturate), nor do rows without vec_id;
shorter vectors count as padded with zeros; a query that stands in several equal rows is one query, and rows with the
query's vec_id are its own and no candidates for it; repeated candidate rows count once; an empty table gives no rows;
other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecspark.llm.common import read, table

K = 20
EVERY = 20
SCALE = 64.0
#: Candidates of a shard, on average; rows of a block; queries scored at once.
SHARD_ROWS = 16_384
BLOCK_ROWS = 128
QUERY_ROWS = 256


def integers(embedding: Column) -> Column:
    """floor(64 * x) of each component, x as double."""
    return F.transform(embedding, lambda x: F.floor(F.lit(SCALE) * x.cast("double")))


def _finite(embedding: Column) -> Column:
    def good(x: Column) -> Column:
        d = x.cast("double")
        return x.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))

    return embedding.isNotNull() & F.coalesce(F.forall(embedding, good), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows padded with zeros."""
    size = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy()
    width = int(size.max(initial=0))
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    at = np.repeat(np.arange(len(size)), size)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


class Shard:
    """Blocks of candidates, ids ascending by position within the shard's tie order."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, block_rows: int = BLOCK_ROWS):
        ids, keep = np.unique(ids, return_index=True)
        rows = rows[keep]
        order = self._like(rows)
        self.ids, self.rows, self.tie = ids, rows[order], (len(ids) - 1 - order)
        self.cuts = [*range(0, len(ids), block_rows), len(ids)]
        pairs = list(zip(self.cuts[:-1], self.cuts[1:], strict=True))
        self.high = np.array([self.rows[a:b].max(0) for a, b in pairs]).reshape(len(pairs), -1)
        self.low = np.array([self.rows[a:b].min(0) for a, b in pairs]).reshape(len(pairs), -1)
        self.read = self.skipped = 0

    @staticmethod
    def _like(rows: np.ndarray) -> np.ndarray:
        """An order in which like vectors are neighbours: by nearest of some rows, taken evenly."""
        n = len(rows)
        if n <= BLOCK_ROWS or not rows.shape[1]:
            return np.arange(n)
        x = rows.astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
        centres = x[:: max(1, n // 64)]
        for _ in range(3):
            near = np.argmax(x @ centres.T, axis=1)
            centres = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        return np.lexsort((np.arange(n), -np.einsum("ij,ij->i", x, centres[near]), near))

    def best(self, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, position of id, score) of each query's k best here, without its own id."""
        width = max(queries.shape[1], self.rows.shape[1])
        q, rows, high, low = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (queries, self.rows, self.high, self.low))
        top = [float(np.abs(x).max(initial=0)) for x in (q, rows)]
        bits = max(1, int(len(self.ids)).bit_length())
        most = top[0] * top[1] * max(1, width)
        if most >= 2.0**53 or most * 2.0**bits >= 2.0**62:
            return self._plain(own, q, rows, k)
        q, rows = q.astype(np.float64), rows.astype(np.float64)
        bound = np.maximum(q, 0) @ high.T.astype(np.float64) + np.minimum(q, 0) @ low.T.astype(np.float64)
        order = np.argsort(-bound, axis=1, kind="stable")
        lowest = np.iinfo(np.int64).min
        keys = np.full((len(q), k), lowest, np.int64)  # score, then the smaller id: one integer
        kth = np.full(len(q), -np.inf)
        at = np.searchsorted(self.ids, own)
        mine = np.where((at < len(self.ids)) & (self.ids[np.minimum(at, len(self.ids) - 1)] == own), len(self.ids) - 1 - at, -1)
        todo = np.arange(len(q))
        for step in range(bound.shape[1]):
            todo = todo[bound[todo, order[todo, step]] >= kth[todo]]
            if not len(todo):
                break
            block = order[todo, step]
            for b in np.unique(block):
                who = todo[block == b]
                a, z = self.cuts[b], self.cuts[b + 1]
                got = ((q[who] @ rows[a:z].T).astype(np.int64) << bits) + self.tie[a:z]
                got[self.tie[a:z][None, :] == mine[who][:, None]] = lowest
                both = np.concatenate([keys[who], got], axis=1)
                keys[who] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                least = keys[who].min(1)
                kth[who] = np.where(least == lowest, -np.inf, (least >> bits).astype(np.float64))
            self.read += len(todo)
        self.skipped += bound.size
        who, place = np.nonzero(keys != lowest)
        found = keys[who, place]
        return who, len(self.ids) - 1 - (found & ((1 << bits) - 1)), found >> bits

    def _plain(self, own: np.ndarray, q: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For values too large for float64: Python integers, every row."""
        out: list[tuple[int, int, int]] = []
        whole = rows.astype(object)
        for i, x in enumerate(q.astype(object)):
            score = whole @ x
            ranked = sorted((-int(s), int(self.ids[len(self.ids) - 1 - t]), int(len(self.ids) - 1 - t)) for s, t in zip(score, self.tie, strict=True) if self.ids[len(self.ids) - 1 - t] != own[i])
            out += [(i, place, -s) for s, _, place in ranked[:k]]
        return tuple(np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def search(embeddings: DataFrame, k: int = K, every: int = EVERY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose vec_id is divisible by `every`, its k best others."""
    spark = embeddings.sparkSession
    usable = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & _finite(F.col("embedding")))
    rows = table(spark, usable.select("vec_id", integers(F.col("embedding")).alias("v")), "vectors")
    shards = max(1, -(-rows.count() // shard_rows))
    candidates = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "v")
    # a stated query set against all rows: each query goes to each shard once
    queries = rows.where(F.col("vec_id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard, its candidates first: one shard is held at a time, and queries stream past it."""
        now, held, shard = None, [], None
        for batch in batches:
            for number in dict.fromkeys(batch.column(0).to_pylist()):
                part = batch.filter(pa.compute.equal(batch.column(0), number))
                if number != now:
                    now, held, shard = number, [], None
                kinds = part.column(1).to_numpy()
                split = int(np.searchsorted(kinds, 1))
                if split:
                    held.append(part.slice(0, split))
                asked = part.slice(split)
                if asked.num_rows and held and shard is None:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    shard = Shard(whole.column(2).to_numpy(), _matrix(whole.column(3).combine_chunks()))
                for a in range(0, asked.num_rows if shard else 0, QUERY_ROWS):
                    some = asked.slice(a, QUERY_ROWS)
                    own = some.column(2).to_numpy()
                    who, place, score = shard.best(own, _matrix(some.column(3)), k)
                    yield pa.RecordBatch.from_arrays([pa.array(own[who]), pa.array(shard.ids[place]), pa.array(score)], ["query_id", "vec_id", "score"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards)
    dealt = candidates.union(queries).repartition(tasks, "shard").sortWithinPartitions("shard", "kind", "vec_id")
    near = dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of each query."""
    return search(read(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
