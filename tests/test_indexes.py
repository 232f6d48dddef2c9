"""Index behaviour on small data sets: exactness at full width, determinism, invariants, errors."""

import time

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecspark.errors import DimensionMismatch, DuplicateId, EmptyDataset, EmptyVector, InvalidConfig, NonFiniteValue, ZeroNorm
from vecspark.functions.distance import Metric, pairwise
from vecspark.operators.flat import FlatIndex
from vecspark.operators.graph import Graph, HnswConfig, HnswIndex, NswConfig, NswIndex
from vecspark.operators.ivf import IvfFlatConfig, IvfFlatIndex
from vecspark.operators.measure import percentile, recall_of
from vecspark.operators.pq import IvfPqConfig, IvfPqIndex
from vecspark.sources.dataset import Dataset

L2, COSINE, DOT = Metric.EUCLIDEAN, Metric.COSINE, Metric.DOT


def line(spark, n):
    return Dataset.from_vectors(spark, [[v, v % 7 + 1] for v in range(n)])


def rows(df):
    return [r["row"] for r in df.collect()]


def of(spark, vectors):
    return Dataset.from_vectors(spark, vectors)


def test_flat_order_ties_and_query_errors(spark):
    index = FlatIndex(of(spark, [[1, 0], [-1, 0], [0, 1]]), L2)
    assert rows(index.search([0, 0], 2)) == [0, 1]
    assert rows(index.search([0, 0], 9)) == [0, 1, 2]
    assert rows(index.search([0, 0], 0)) == []
    with pytest.raises(DimensionMismatch):
        index.search([0], 1)
    with pytest.raises(NonFiniteValue):
        index.search([float("nan"), 0], 1)
    with pytest.raises(NonFiniteValue):
        index.search([1e39, 0], 1)


@pytest.mark.parametrize(("vectors", "metric", "error", "text"), [([], L2, EmptyDataset, "one or more"), ([[]], L2, EmptyVector, "one component"), ([[1], [1, 2]], L2, DimensionMismatch, "2 components where all have 1"), ([[1, 2], [1, float("inf")]], L2, NonFiniteValue, "component 1 of vector 1"), ([[1, float("nan")], [1]], L2, NonFiniteValue, "of vector 0"), ([[1, 0], [0, 0]], COSINE, ZeroNorm, "vector 1 is all zeros")])
def test_rejected_data(spark, vectors, metric, error, text):
    with pytest.raises(error, match=text):
        FlatIndex(of(spark, vectors), metric)


def test_ivf_with_all_lists_is_exact(spark):
    data = line(spark, 80)
    index = IvfFlatIndex(data, L2, IvfFlatConfig(8, 2, 10, 7))
    exact = FlatIndex(data, L2).search([31.2, 4.0], 12).collect()
    assert index.search([31.2, 4.0], 12, 8).collect() == exact
    assert sum(r["rows"] for r in index.list_sizes().collect()) == 80
    with pytest.raises(InvalidConfig):
        index.search([31.2, 4.0], 12, 9)


def test_ivf_is_seeded(spark):
    a, b = (IvfFlatIndex(line(spark, 60), L2, IvfFlatConfig(6, 2, 8, 42)) for _ in range(2))
    assert (a.centroids == b.centroids).all()
    assert sorted(a.list_sizes().collect()) == sorted(b.list_sizes().collect())


def test_ivf_zero_mean_and_empty_clusters(spark):
    index = IvfFlatIndex(of(spark, [[1, 0], [-1, 0], [0, 1], [0, -1]]), COSINE, IvfFlatConfig(1, 1, 3, 1))
    assert np.isfinite(index.centroids).all() and len(rows(index.search([1, 0], 4))) == 4
    same = of(spark, [[1, 1]] * 6 + [[9, 9], [50, 50]])
    reseeded = IvfFlatIndex(same, L2, IvfFlatConfig(4, 1, 3, 3))
    assert {50.0, 9.0} & {float(c[0]) for c in reseeded.centroids}
    kept = IvfFlatIndex(same, L2, IvfFlatConfig(4, 1, 3, 3, "keep"))
    assert np.isfinite(kept.centroids).all()


def test_ivf_dot_and_insert(spark, tmp_path):
    data = line(spark, 40)
    index = IvfFlatIndex(data, DOT, IvfFlatConfig(4, 4, 4, 7))
    assert rows(index.search([1.0, 0.0], 3)) == [39, 38, 37]
    stored = IvfFlatIndex(data, L2, IvfFlatConfig(4, 4, 4, 7), path=str(tmp_path / "postings"))
    assert stored.insert(spark.createDataFrame([(100, [12.1, 4.0])], "row bigint, embedding array<float>")) == 1
    assert rows(stored.search([12.1, 4.0], 1)) == [100]
    assert "PartitionFilters: [isnotnull(partition" in stored.search([12.1, 4.0], 1, 1)._jdf.queryExecution().executedPlan().toString()
    stored.delete(spark.createDataFrame([(100,)], "row bigint"))
    assert rows(stored.search([12.1, 4.0], 1)) != [100]


@pytest.mark.parametrize("config", [IvfFlatConfig(0, 1, 1, 1), IvfFlatConfig(33, 1, 1, 1), IvfFlatConfig(4, 5, 1, 1), IvfFlatConfig(4, 0, 1, 1), IvfFlatConfig(4, 1, 0, 1)])
def test_ivf_settings(spark, config):
    with pytest.raises(InvalidConfig):
        config.check(32)


def test_pq_settings():
    good = IvfPqConfig(4, 2, 4, 2, 4, 8, 1)
    good.check(32, 2, L2)
    for bad, metric in ((good, COSINE), (IvfPqConfig(4, 2, 4, 3, 4, 8, 1), L2), (IvfPqConfig(4, 2, 4, 2, 1, 8, 1), L2), (IvfPqConfig(4, 2, 4, 2, 33, 8, 1), L2), (IvfPqConfig(4, 2, 4, 2, 4, 0, 1), L2)):
        with pytest.raises(InvalidConfig):
            bad.check(32, 2, metric)


def test_pq_full_width_is_exact_and_sizes(spark):
    data = line(spark, 80)
    index = IvfPqIndex(data, L2, IvfPqConfig(8, 8, 10, 2, 8, 80, 7))
    assert index.search([31.2, 4.0], 12).collect() == FlatIndex(data, L2).search([31.2, 4.0], 12).collect()
    assert (index.encoded_bytes(), index.codebook_bytes(), index.full_precision_bytes()) == (160, 64, 640)
    assert index.codes.count() == 80 and rows(index.search([31.2, 4.0], 0)) == []
    with pytest.raises(InvalidConfig):
        index.search([31.2, 4.0], 1, 8, 0)


def test_pq_full_query_ranks_every_row(spark, oracle, monkeypatch):
    """More rows than the configured rerank, as beyond 100,000: the answer stays that of exact search."""
    from dataclasses import replace

    from conftest import DATA, same_form

    from vecspark import queries

    monkeypatch.setattr(queries, "PQ", replace(queries.PQ, rerank=12))
    assert same_form(queries.pq_topk_full(spark, f"{DATA}/sf0.001").toPandas()) == oracle("sf0.001", queries.SQL["pq_topk_full"])


def test_pq_full_query_sends_on_k_rows_a_batch(spark):
    """Of a rerank of every row no table of all pairs is made: at 51,282 rows it held 131 million."""
    data = line(spark, 600)
    index = IvfPqIndex(data, L2, IvfPqConfig(4, 2, 2, 2, 8, 10, 7))
    queries = np.array([[v, 3.0] for v in range(0, 600, 20)], np.float32)
    for probes in (4, 2):
        sent = index._ranked(np.arange(30), queries, 5, probes, 600)
        assert sent.count() <= 30 * 5 * max(8, data.df.rdd.getNumPartitions())
        found = index.search_batch(spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "qid bigint, embedding array<float>"), 5, probes, 600)
        lists = {r["row"]: r["partition"] for r in index.codes.collect()}
        for i in (0, 10, 20):
            q = queries[i]
            probed = index._lists(q[None, :], probes)[0]
            among = [(float(np.float32(np.hypot(q[0] - v, q[1] - (v % 7 + 1)))), v) for v in range(600) if lists[v] in probed]
            assert [r["row"] for r in found.where(f"qid = {i}").orderBy("rank").collect()] == [v for _, v in sorted(among)[:5]]


def test_pq_magnitudes(spark):
    big = of(spark, [[3e20], [2e20], [1e20]])
    assert rows(IvfPqIndex(big, L2, IvfPqConfig(1, 1, 2, 1, 2, 3, 7)).search([0.0], 1)) == [2]
    four = of(spark, [[x, x] for x in (2e38, 2.5e38, 3e38, 3.3e38)])
    got = IvfPqIndex(four, L2, IvfPqConfig(1, 1, 2, 1, 2, 4, 7)).search([0.0, 0.0], 1).collect()
    assert got[0]["row"] == 0 and np.isfinite(got[0]["distance"])
    with pytest.raises(InvalidConfig, match="representable"):
        IvfPqIndex(of(spark, [[3e38, 3e38], [2.5e38, 2.5e38]]), L2, IvfPqConfig(1, 1, 2, 1, 2, 2, 7)).search([0.0, 0.0], 2)
    mixed = IvfPqIndex(of(spark, [[1, 0], [3e38, 3e38]]), L2, IvfPqConfig(1, 1, 2, 1, 2, 2, 7))
    assert [(r["row"], r["distance"]) for r in mixed.search([0.0, 0.0], 1).collect()] == [(0, 1.0)]
    tie = IvfPqIndex(of(spark, [[1, float(np.finfo(np.float32).eps)], [1, 0]]), L2, IvfPqConfig(1, 1, 2, 1, 2, 2, 7))
    assert rows(tie.search([0.0, 0.0], 1)) == [0]
    with pytest.raises(InvalidConfig, match="residuals"):
        f = float(np.finfo(np.float32).max)
        IvfPqIndex(of(spark, [[f], [f], [-f]]), L2, IvfPqConfig(1, 1, 1, 1, 2, 3, 7))


def _edges(index):
    found = {}
    for r in index.edges.collect():
        found.setdefault(r["level"], {})[r["row"]] = r["neighbors"]
    return found


@pytest.mark.parametrize("shards", [1, 3])
def test_nsw_wide_is_exact_and_graph_is_sound(spark, shards):
    data = line(spark, 64)
    index = NswIndex(data, L2, NswConfig(8, 32, 32), shards)
    if shards == 1:
        assert index.search([17.4, 4.0], 10, 64).collect() == FlatIndex(data, L2).search([17.4, 4.0], 10).collect()
    layer = _edges(index)[0]
    assert len(layer) == 64 and all(len(n) <= 8 for n in layer.values())
    assert all(a in layer[b] for a, near in layer.items() for b in near)
    with pytest.raises(InvalidConfig):
        index.search([17.4, 4.0], 10, 0)


def test_hnsw_is_seeded_nested_and_exact_when_wide(spark):
    data = line(spark, 96)
    a, b = (HnswIndex(data, L2, HnswConfig(8, 40, 40, 8, 99)) for _ in range(2))
    assert _edges(a) == _edges(b)
    layers = _edges(a)
    assert a.top_level() == max(layers) > 0
    for level, layer in layers.items():
        assert all(len(n) <= 8 for n in layer.values())
        assert all(x in layer[y] for x, near in layer.items() for y in near)
        assert set(layer) == {r["row"] for r in a.levels().where(f"level >= {level}").collect()}
    assert a.search([72.6, 3.0], 10, 96).collect() == FlatIndex(data, L2).search([72.6, 3.0], 10).collect()


def test_graph_insert_and_variants(spark):
    index = HnswIndex(of(spark, [[v, 1, 1] for v in range(6)]), L2, HnswConfig(5, 64, 10, 8, 7))
    assert rows(index.search([1.0, 1.0, 1.0], 3)) == [1, 0, 2]
    new = spark.createDataFrame([(10 + i, [-float(i), 1.0, 1.0]) for i in range(1, 5)], "row bigint, embedding array<float>")
    assert index.insert(new) == 4
    assert sorted(rows(index.search([1.0, 1.0, 1.0], 5))) == [0, 1, 2, 3, 11]
    wide = HnswIndex(line(spark, 60), L2, HnswConfig(4, 16, 16, 8, 7, "log", 4))
    assert max(len(n) for n in _edges(wide)[0].values()) > 4
    with pytest.raises(InvalidConfig):
        HnswConfig(1, 4, 4, 4, 7, "log").check()


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=1, max_size=40), st.integers(1, 5), st.integers(1, 12))
def test_graph_kernel_invariants(points, m, k):
    x = np.array(points, np.float32)
    graph = Graph(L2, NswConfig(m, max(m, 8), 8), np.arange(len(x)), x)
    for n in range(len(x)):
        graph.insert(n)
    layer = graph.layers[0]
    assert all(len(near) <= m and n not in near for n, near in layer.items())
    assert all(a in layer[b] for a, near in layer.items() for b in near)
    found = graph.search(x[0], k, len(x))
    assert found == sorted(found) and len(found) <= k


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.floats(-1e3, 1e3, width=32), min_size=3, max_size=3), min_size=1, max_size=8), st.lists(st.floats(-1e3, 1e3, width=32), min_size=3, max_size=3))
def test_pairwise(vectors, query):
    x, q = np.array(vectors, np.float32), np.array(query, np.float32)
    assert np.allclose(pairwise(L2, q[None], x)[0], np.linalg.norm(x.astype(float) - q, axis=1), rtol=1e-5)
    assert np.allclose(pairwise(DOT, q[None], x)[0], -(x.astype(float) @ q), rtol=1e-4, atol=1e-3)


def test_batches_equal_single_searches(spark):
    data = line(spark, 50)
    queries = spark.createDataFrame([(7, [3.2, 2.0]), (9, [40.0, 5.5])], "qid bigint, embedding array<float>")
    for index in (FlatIndex(data, L2), IvfFlatIndex(data, L2, IvfFlatConfig(5, 2, 4, 7)), IvfPqIndex(data, L2, IvfPqConfig(5, 2, 4, 2, 4, 10, 7)), NswIndex(data, L2, NswConfig(6, 12, 12)), HnswIndex(data, L2, HnswConfig(6, 12, 12, 4, 7))):
        got = index.search_batch(queries, 4).orderBy("qid", "rank").collect()
        for qid, q in ((7, [3.2, 2.0]), (9, [40.0, 5.5])):
            assert [r["row"] for r in got if r["qid"] == qid] == rows(index.search(q, 4)), index.kind


def test_recall_and_percentile():
    assert recall_of([0, 1, 2, 3], [0, 2, 9], 3) == 2 / 3
    assert recall_of([], [1], 3) == 1.0
    assert [percentile(range(1, 101), p) for p in (0, 50, 99)] == [1, 50, 99]


def test_duplicate_ids(spark):
    from vecspark.plans.table import VectorTable

    with pytest.raises(DuplicateId, match="duplicate vector id 1"):
        VectorTable.from_rows(spark, [(1, [1, 0], "left"), (1, [0, float("nan")], "right")])


def test_ivf_saved_and_reopened(spark, tmp_path):
    data = of(spark, [[float(i), float(i % 7) + 1] for i in range(60)])
    index = IvfFlatIndex(data, L2, IvfFlatConfig(4, 2, 3, 7))
    index.save(f"{tmp_path}/index")
    again = IvfFlatIndex.open(spark, f"{tmp_path}/index")
    assert again.config == index.config and again.metric is index.metric and again.dataset.rows == 60
    for q in ([3.3, 2.0], [40.5, 1.0]):
        assert again.search(q, 7).collect() == index.search(q, 7).collect()
    assert again.insert(spark.createDataFrame([(99, [3.3, 2.0])], "row bigint, embedding array<float>")) == 1
    assert rows(again.search([3.3, 2.0], 1)) == [99]


def test_pq_batch_rejects_what_single_search_rejects(spark):
    index = IvfPqIndex(of(spark, [[3e38, 3e38], [2.5e38, 2.5e38]]), L2, IvfPqConfig(2, 2, 2, 1, 2, 2, 7))
    queries = spark.createDataFrame([(0, [-3e38, -3e38])], "qid bigint, embedding array<float>")
    with pytest.raises(InvalidConfig, match="representable"):
        index.search([-3e38, -3e38], 2).collect()
    with pytest.raises(InvalidConfig, match="representable"):
        index.search_batch(queries, 2).collect()


def _apart(n=40):
    """Two groups of rows by turns, each nearer to its own kind than to the other by far: pruning parts their graphs."""
    return [[(1000.0 if i % 2 else 1.0) + i / 100, 1.0 + i * i % 11, (-1000.0 if i % 2 else 1.0)] for i in range(n)]


def test_hnsw_parted_graph_is_exact_when_wide(spark):
    """As on tables of 10,000 rows: what no edge leads to is found all the same, by wide beams and by narrow ones."""
    data = of(spark, _apart())
    index = HnswIndex(data, COSINE, HnswConfig(3, 4, 4, 1, 7))
    graph = Graph.load(COSINE, index.config, np.arange(40), np.array(_apart(), np.float32), index.edges.toPandas())
    assert len(graph.entries()) > 1 and len(graph.reached(graph.layers[0], [graph.entry])) < 40
    for q in ([1.0, 3.0, 1.0], [900.0, 3.0, -900.0]):
        want = FlatIndex(data, COSINE).search(q, 40).collect()
        assert [r["row"] for r in index.search(q, 40, 40).collect()] == [r["row"] for r in want]
        assert index.search(q, 1, 8).first()["row"] == want[0]["row"]


def test_nsw_parted_graph_is_exact_when_wide(spark):
    data = of(spark, _apart())
    index = NswIndex(data, COSINE, NswConfig(3, 4, 4))
    graph = Graph.load(COSINE, index.config, np.arange(40), np.array(_apart(), np.float32), index.edges.toPandas())
    assert len(graph.entries()) > 1 and len(graph.reached(graph.layers[0], [graph.entry])) < 40
    queries = spark.createDataFrame([(0, [1.0, 3.0, 1.0]), (1, [900.0, 3.0, -900.0])], "qid bigint, embedding array<float>")
    want = FlatIndex(data, COSINE).search_batch(queries, 10)
    assert sorted(index.search_batch(queries, 10, 40).collect()) == sorted(want.collect())


@pytest.mark.parametrize("metric", [L2, COSINE, DOT])
def test_graph_of_blocks_is_that_of_single_insertions(metric):
    x = np.random.default_rng(5).standard_normal((300, 8)).astype(np.float32)
    config = HnswConfig(4, 12, 12, 6, 7)
    one, blocks = (Graph(metric, config, np.arange(300), x) for _ in range(2))
    for n in range(300):
        one.insert(n)
    blocks.extend(range(200))
    table = blocks.table(0)
    again = Graph.load(metric, config, np.arange(300), x, table)
    for graph in (blocks, again):
        graph.extend(range(200, 300))
        assert graph.entry == one.entry and [{n: set(near) for n, near in layer.items()} for layer in graph.layers] == [{n: set(near) for n, near in layer.items()} for layer in one.layers]
    wide = {(b["qid"][i].as_py(), b["row"][i].as_py()) for b in blocks.search_batch(x[:150], 3, 300) for i in range(b.num_rows)}
    assert wide == {(q, n) for q in range(150) for _, n in one.search(x[q], 3, 300)}


def test_hnsw_build_and_wide_batches_take_seconds(spark):
    """Before, this took 74 s in all, now 22: each step of a walk widened and normed its vectors again, each query walked alone."""
    x = np.random.default_rng(6).standard_normal((4000, 64)).astype(np.float32)
    data = of(spark, x)
    queries = data.df.where("row % 20 = 0").select(F.col("row").alias("qid"), "embedding")
    began = time.monotonic()
    got = HnswIndex(data, COSINE, HnswConfig(12, 64, 40, 8, 7)).search_batch(queries, 10, 4000).collect()
    assert time.monotonic() - began < 40
    assert sorted(got) == sorted(FlatIndex(data, COSINE).search_batch(queries, 10).collect())
