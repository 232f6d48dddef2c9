"""Navigable small-world graphs, one layer or a hierarchy.

Insertion and traversal are sequential by definition, so they run in a Python kernel on one shard of rows; shards are
built and searched in parallel, and the nearest of all shards are ranked together. One shard is a single graph; SHARD_ROWS
bounds what a task holds. The graph is a table (shard, level, row, neighbors): all state between tasks is DataFrames.

Pruning takes edges at both ends, so a graph can fall into parts that no walk connects. A search begins in each of them.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions.distance import Metric, pairwise
from vecspark.operators.index import BATCH_SCHEMA, VectorIndex, nearest_of, need
from vecspark.sources.dataset import Dataset

SHARD_ROWS = 10_000
#: Queries, or rows to insert, whose distances to all rows of a shard a task holds at once.
BLOCK = 64
#: Distances of a walk's query to nodes.
Far = Callable[[Sequence[int]], Iterable[float]]
FOUND = pa.schema([("qid", pa.int64()), ("row", pa.int64()), ("distance", pa.float32())])
EDGES = "shard int, level int, row bigint, neighbors array<bigint>"


@dataclass(frozen=True)
class NswConfig:
    max_connections: int = 12
    ef_construction: int = 48
    ef_search: int = 32

    def check(self) -> None:
        need(self.max_connections > 0, "a node needs one connection or more")
        need(self.ef_construction >= self.max_connections, "the beam of a build is as wide as a node has connections, or wider")
        need(self.ef_search > 0, "the beam of a search has to be positive")

    def level(self, row: int) -> int:
        return 0

    def cap(self, level: int) -> int:
        return self.max_connections


@dataclass(frozen=True)
class HnswConfig:
    max_connections: int = 12
    ef_construction: int = 64
    ef_search: int = 40
    max_level: int = 16
    seed: int = 0x5EED
    #: "coin": a fair coin a level. "log": floor(-ln(u) / ln(max_connections)).
    levels: str = "coin"
    #: Layer 0 keeps max_connections times this many edges a row.
    base_factor: int = 1

    def check(self) -> None:
        need(self.max_connections > 0, "a node needs one connection or more")
        need(self.ef_construction >= self.max_connections, "the beam of a build is as wide as a node has connections, or wider")
        need(self.ef_search > 0, "the beam of a search has to be positive")
        need(self.max_level > 0, "one level or more")
        need(self.levels == "coin" or self.max_connections > 1, "logarithmic levels need two connections or more")

    def level(self, row: int) -> int:
        """Drawn from the digest of seed and row: the ones it begins with, or the logarithm of it as a fraction."""
        bits = int.from_bytes(hashlib.md5(f"{self.seed}:{row}".encode()).digest(), "big")
        if self.levels == "log":
            return min(self.max_level, int(-math.log((bits + 1) / (1 << 128)) / math.log(self.max_connections)))
        ones = 128 - ((~bits) & ((1 << 128) - 1)).bit_length()
        return min(self.max_level, ones)

    def cap(self, level: int) -> int:
        return self.max_connections * (self.base_factor if level == 0 else 1)


class Graph:
    """A shard's layers: local numbers in insertion order, ties by number. Ids are ascending, so ties are by row.

    Walks compare distances in double, of vectors that were brought to unit length once for the cosine. What a search returns
    is ranked by `pairwise` again.
    """

    def __init__(self, metric: Metric, config: NswConfig | HnswConfig, ids: np.ndarray, vectors: np.ndarray):
        self.metric, self.config, self.ids, self.x = metric, config, ids, vectors.astype(np.float32)
        self.wide = self._wide(self.x)
        self.layers: list[dict[int, list[int]]] = []
        #: Of each layer, the distances along a node's edges in their order; of loaded nodes when they are first needed.
        self.spans: list[dict[int, list[float]]] = []
        self.entry = -1
        self.parts: list[int] | None = None

    def _wide(self, vectors: np.ndarray) -> np.ndarray:
        out = vectors.astype(np.float64)
        if self.metric is Metric.COSINE:
            with np.errstate(divide="ignore", invalid="ignore"):
                out /= np.sqrt(np.vecdot(out, out))[..., None]
        return out

    def _far(self, q: np.ndarray, nodes: Sequence[int]) -> list[float]:
        """In the order of the distances to a query as of _wide: squares, or negated inner products. Equal rows tie."""
        x = self.wide.take(nodes, 0)
        if self.metric is Metric.EUCLIDEAN:
            x -= q
            return np.vecdot(x, x).tolist()
        return np.negative(np.vecdot(x, q)).tolist()

    def _fars(self, nodes: Sequence[int]) -> Iterator[Far]:
        """_far of each node, to those before and the graph's. Inner products come of one product of matrices a block."""
        if self.metric is Metric.EUCLIDEAN:
            yield from (partial(self._far, self.wide[node]) for node in nodes)
            return
        last = max(self.layers[0], default=-1) if self.layers else -1
        for a in range(0, len(nodes), BLOCK):
            block = list(nodes[a : a + BLOCK])
            last = max(last, *block)
            for row in -(self.wide[block] @ self.wide[: last + 1].T):
                yield partial(map, row.tolist().__getitem__)

    def beam(self, far: Far, layer: dict[int, list[int]], entries: Iterable[int], width: int) -> list[tuple[float, int]]:
        """The nearest `width` that a best-first walk finds, nearest first."""
        starts = [n for n in dict.fromkeys(entries) if n in layer]
        if not starts:
            return []
        width = min(max(width, 1), len(layer))
        if width == len(layer):  # no row is turned away, so the walk's order doesn't matter
            nodes = self.reached(layer, starts)
            return sorted(zip(far(nodes), nodes, strict=True))
        best = sorted(zip(far(starts), starts, strict=True))[:width]
        seen, walked = set(starts), set()
        last = best[-1] if len(best) == width else (math.inf, 0)
        at = 0  # all before it have been walked from
        while at < len(best):
            node = best[at][1]
            at += 1
            if node in walked:
                continue
            walked.add(node)
            fresh = [n for n in layer[node] if n not in seen]
            seen.update(fresh)
            for pair in zip(far(fresh), fresh, strict=True) if fresh else ():
                if pair > last:
                    continue
                i = bisect(best, pair)
                best.insert(i, pair)
                at = min(at, i)
                if len(best) > width:
                    best.pop()
                if len(best) == width:
                    last = best[-1]
        return best

    @staticmethod
    def reached(layer: dict[int, list[int]], starts: Iterable[int]) -> list[int]:
        """All nodes that edges lead to from the starts, and these."""
        out = list(starts)
        seen = set(out)
        for node in out:  # grows as it is read
            fresh = [n for n in layer[node] if n not in seen]
            seen.update(fresh)
            out += fresh
        return out

    def entries(self) -> list[int]:
        """The first node of each part of layer 0; found once, when all nodes are in."""
        if self.parts is None:
            self.parts, seen = [], set()
            for node in sorted(self.layers[0]):
                if node not in seen:
                    self.parts.append(node)
                    seen.update(self.reached(self.layers[0], [node]))
        return self.parts

    def descend(self, far: Far, layer: dict[int, list[int]], node: int) -> int:
        """Steps to the nearest neighbour as long as that is nearer."""
        at = (*far([node]), node)
        while layer[at[1]]:
            step = min(zip(far(layer[at[1]]), layer[at[1]], strict=True))
            if step >= at:
                break
            at = step
        return at[1]

    def _spans(self, level: int, node: int) -> list[float]:
        spans = self.spans[level]
        if node not in spans:
            spans[node] = self._far(self.wide[node], self.layers[level][node]) if self.layers[level][node] else []
        return spans[node]

    def _prune(self, level: int, owner: int, cap: int) -> None:
        """Keeps an owner's nearest edges; a dropped one goes at both ends."""
        layer, near, spans = self.layers[level], self.layers[level][owner], self._spans(level, owner)
        while len(near) > cap:
            at = spans.index(max(spans))
            if spans.count(spans[at]) > 1:
                at = near.index(max(zip(spans, near, strict=True))[1])
            other = near.pop(at)
            del spans[at]
            back = self._spans(level, other)
            at = layer[other].index(owner)
            del layer[other][at], back[at]

    def extend(self, nodes: Sequence[int]) -> None:
        """Inserts nodes one after the other."""
        for node, far in zip(nodes, self._fars(nodes), strict=True):
            self.insert(node, far)

    def insert(self, node: int, far: Far | None = None) -> None:
        level, far, self.parts = self.config.level(int(self.ids[node])), far or partial(self._far, self.wide[node]), None
        old_top = len(self.layers) - 1
        hierarchy = isinstance(self.config, HnswConfig)
        entries = [self.entry]
        if old_top >= 0:
            for k in range(old_top, level, -1):
                entries = [self.descend(far, self.layers[k], entries[0])]
            for k in range(min(level, old_top), -1, -1):
                layer, cap = self.layers[k], self.config.cap(k)
                found = self.beam(far, layer, entries, max(self.config.ef_construction, cap))
                chosen = found[:cap]
                layer[node], self.spans[k][node] = [n for _, n in chosen], [d for d, _ in chosen]
                for d, n in chosen:
                    self._spans(k, n).append(d)
                    layer[n].append(node)
                for n in sorted(n for _, n in chosen):
                    if len(layer[n]) > cap:
                        self._prune(k, n, cap)
                entries = [n for _, n in found[:1]] or entries
        while len(self.layers) <= level:
            self.layers.append({node: []})
            self.spans.append({node: []})
        if not hierarchy or level > old_top:
            self.entry = node

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        return [(d, n) for batch in self.search_batch(q[None, :], k, ef) for d, n in zip(batch["distance"].to_pylist(), batch["row"].to_pylist(), strict=True)]

    def search_batch(self, queries: np.ndarray, k: int, ef: int) -> Iterator[pa.RecordBatch]:
        """(qid, row, distance) of the k nearest that each query's walk finds: numbers of queries and nodes."""
        if not self.layers or not k:
            return
        base, width = self.layers[0], max(ef, k)
        if width >= len(base):  # no walk turns a node away, so all queries take the same one
            nodes = np.array(self.reached(base, self.entries()))
            x = self.x[nodes]
            for a in range(0, len(queries), BLOCK):
                some = queries[a : a + BLOCK]
                yield nearest_of(np.arange(a, a + len(some)), nodes, pairwise(self.metric, some, x), k)
            return
        for i, q in enumerate(self._wide(queries)):
            node, far = self.entry, partial(self._far, q)
            for layer in self.layers[:0:-1]:
                node = self.descend(far, layer, node)
            nodes = np.array([n for _, n in self.beam(far, base, [node, *self.entries()], width)])
            yield nearest_of(np.array([i]), nodes, pairwise(self.metric, queries[i : i + 1], self.x[nodes]), k)

    def table(self, shard: int) -> pd.DataFrame:
        rows = [(shard, level, int(self.ids[n]), [int(self.ids[m]) for m in near]) for level, layer in enumerate(self.layers) for n, near in sorted(layer.items())]
        return pd.DataFrame(rows, columns=["shard", "level", "row", "neighbors"])

    @classmethod
    def load(cls, metric: Metric, config: NswConfig | HnswConfig, ids: np.ndarray, vectors: np.ndarray, edges: pd.DataFrame) -> Graph:
        """The graph of a table. The entry is the last inserted row, or the first one of the highest level."""
        graph = cls(metric, config, ids, vectors)
        at = {int(i): n for n, i in enumerate(ids)}
        graph.layers = [{} for _ in range(int(edges["level"].max()) + 1)] if len(edges) else []
        graph.spans = [{} for _ in graph.layers]
        for level, row, near in zip(edges["level"], edges["row"], edges["neighbors"], strict=True):
            graph.layers[level][at[int(row)]] = [at[int(n)] for n in near]
        if graph.layers:
            graph.entry = min(graph.layers[-1]) if isinstance(config, HnswConfig) else max(graph.layers[0])
        return graph


def _sorted(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("row")
    return pdf["row"].to_numpy(np.int64), np.array(pdf["embedding"].tolist(), np.float32)


class GraphIndex(VectorIndex):
    """rows (shard, row, embedding) and edges (shard, level, row, neighbors)."""

    config_type: type

    def __init__(self, dataset: Dataset, metric: Metric, config: NswConfig | HnswConfig | None = None, shards: int | None = None):
        super().__init__(dataset, metric)
        self.config = config or self.config_type()
        self.config.check()
        self.shards = shards or max(1, -(-dataset.rows // SHARD_ROWS))
        #: A task a shard: hashed shards would meet in some tasks and leave others idle.
        self.rows = dataset.df.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(self.shards)).cast("int")).repartitionById(self.shards, F.col("shard")).persist()
        metric, config = self.metric, self.config

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            ids, vectors = _sorted(pdf)
            graph = Graph(metric, config, ids, vectors)
            graph.extend(range(len(ids)))
            return graph.table(int(pdf["shard"].iloc[0]))

        self.edges = self.rows.groupBy("shard").applyInPandas(build, EDGES).persist()
        self.edges.count()  # else each block of queries that is searched at once builds the graphs for itself

    def adjacency(self, level: int = 0) -> DataFrame:
        return self.edges.where(F.col("level") == level).select("row", "neighbors")

    def levels(self) -> DataFrame:
        """(row, level): the highest layer of each row."""
        return self.edges.groupBy("row").agg(F.max("level").alias("level"))

    def top_level(self) -> int:
        return self.edges.agg(F.max("level")).first()[0]

    def _found(self, qids: np.ndarray, vectors: np.ndarray, k: int, ef: int) -> DataFrame:
        shared = self.dataset.spark.sparkContext.broadcast((qids, vectors))
        metric, config = self.metric, self.config

        def walk(rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
            graph = Graph.load(metric, config, *_sorted(rows), edges)
            qids, vectors = shared.value
            out = pa.Table.from_batches(graph.search_batch(vectors, k, ef), FOUND).to_pandas()
            return out.assign(qid=qids[out["qid"]], row=graph.ids[out["row"]])

        return self.rows.groupBy("shard").cogroup(self.edges.groupBy("shard")).applyInPandas(walk, BATCH_SCHEMA)

    def _ef(self, ef: int | None) -> int:
        need(ef is None or ef > 0, "the beam of a search has to be positive")
        return ef or self.config.ef_search

    def search(self, query: Sequence[float], k: int, ef: int | None = None) -> DataFrame:
        q = self.dataset.checked_query(query, self.metric)
        return self._found(np.zeros(1, np.int64), q[None, :], k, self._ef(ef)).select("row", "distance").orderBy("distance", "row").limit(k)

    def search_batch(self, queries: DataFrame, k: int, ef: int | None = None) -> DataFrame:
        ef = self._ef(ef)
        return self._blocks(queries, k, lambda qids, vectors: self._found(qids, vectors, k, ef))

    def insert(self, rows: DataFrame) -> int:
        """Adds rows to the graphs of their shards; they are inserted behind those that are there."""
        new = Dataset.of(rows).require(self.metric)
        if new.dimension != self.dataset.dimension:
            self.dataset.checked_query([0.0] * new.dimension, Metric.EUCLIDEAN)
        added = new.df.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(self.shards)).cast("int"))
        both = self.rows.withColumn("new", F.lit(False)).unionByName(added.withColumn("new", F.lit(True)))
        metric, config = self.metric, self.config

        def extend(rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
            ids, vectors = _sorted(rows)
            graph = Graph.load(metric, config, ids, vectors, edges)
            fresh = set(rows.loc[rows["new"], "row"].tolist())
            graph.extend([n for n, i in enumerate(ids.tolist()) if i in fresh])
            return graph.table(int(rows["shard"].iloc[0]))

        edges = both.groupBy("shard").cogroup(self.edges.groupBy("shard")).applyInPandas(extend, EDGES).persist()
        edges.count()
        self.edges, self.rows = edges, both.drop("new").persist()
        self.dataset = Dataset(self.dataset.df.union(new.df), self.dataset.dimension, self.dataset.rows + new.rows)
        return new.rows


class NswIndex(GraphIndex):
    kind, config_type = "nsw", NswConfig


class HnswIndex(GraphIndex):
    kind, config_type = "hnsw", HnswConfig
