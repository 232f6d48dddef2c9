"""SQL text through indexes: which shapes are lowered, and that answers don't change."""

import pytest

from vecspark.errors import DimensionMismatch, DuplicateId
from vecspark.operators.graph import HnswConfig, NswConfig
from vecspark.operators.ivf import IvfFlatConfig
from vecspark.operators.pq import IvfPqConfig
from vecspark.plans.session import VectorSession
from vecspark.plans.table import VectorTable

ROWS = [(10, [1, 0, 0], "east"), (20, [0.9, 0.1, 0], "east"), (30, [0, 1, 0], "north"), (40, [-1, 0, 0], "west"), (50, [0, 0, 1], "up")]
TOP = "SELECT id, payload FROM points ORDER BY cosine_distance(embedding, array(1.0, 0.0, 0.0)) LIMIT 2"


def session(spark, metric="cosine", config=None, rows=ROWS):
    s = VectorSession(spark)
    s.register("points", VectorTable.from_rows(spark, rows, metric, config))
    return s


def ids(df):
    return [r[0] for r in df.collect()]


def test_top_k_uses_index_and_keeps_sort(spark):
    s = session(spark)
    assert s.explain(TOP) == "Sort: TopK(fetch=2)\nVectorIndexScan: index=flat, name=default, metric=Cosine, query_dim=3, fetch=2, ordered=false"
    assert s.sql(TOP).collect() == [(10, "east"), (20, "east")]


def test_ordered_mode_elides_sort_and_can_be_reset(spark):
    s = session(spark)
    s.sql("SET vector_search.ordered = true")
    assert "Sort" not in s.explain(TOP) and "ordered=true" in s.explain(TOP)
    assert ids(s.sql(TOP)) == [10, 20]
    s.sql("SET vector_search.ordered = false")
    assert "Sort: TopK(fetch=2)" in s.explain(TOP)


@pytest.mark.parametrize(("text", "want"), [
    ("SELECT id FROM points WHERE payload = 'north' ORDER BY cosine_distance(embedding, array(1.0, 0.0, 0.0)) LIMIT 1", [30]),
    ("SELECT id FROM points ORDER BY array_distance(embedding, array(1.0, 0.0, 0.0)) LIMIT 2", [10, 20]),
    ("SELECT id FROM points ORDER BY cosine_distance(embedding, array(1.0, 0.0, 0.0)) DESC LIMIT 1", [40]),
    ("SELECT id FROM points ORDER BY cosine_distance(embedding, array(1.0, 0.0, 0.0)), id LIMIT 2", [10, 20]),
    ("SELECT id FROM points ORDER BY cosine_distance(embedding, embedding), id LIMIT 2", [10, 20]),
    ("SELECT id FROM (SELECT * FROM points ORDER BY id DESC LIMIT 4) x ORDER BY cosine_distance(embedding, array(1D, 0D, 0D)) LIMIT 1", [20]),
    ("SELECT max(id) AS id FROM points GROUP BY payload ORDER BY id LIMIT 1", [20]),
    ("SELECT id + (SELECT count(*) FROM points) AS i FROM points ORDER BY cosine_distance(embedding, array(1D, 0D, 0D)) LIMIT 1", [15]),
    ("SELECT a.id FROM points a JOIN points b ON a.id = b.id ORDER BY cosine_distance(a.embedding, array(1D, 0D, 0D)) LIMIT 1", [10]),
    ("SELECT id FROM points ORDER BY cosine_distance(embedding, array(1.0, CAST(NULL AS DOUBLE), 0.0)) NULLS LAST, id LIMIT 1", [10]),
    ("SELECT id FROM points ORDER BY id LIMIT 2", [10, 20]),
])
def test_other_shapes_stay_exact(spark, text, want):
    s = session(spark)
    assert "VectorIndexScan" not in s.explain(text)
    if "NULL AS" not in text:
        assert ids(s.sql(text)) == want


def test_no_limit_is_exact_over_all_rows(spark):
    s = session(spark, config=IvfFlatConfig(5, 1, 2, 7))
    text = "SELECT id FROM points ORDER BY cosine_distance(embedding, array(1D, 0D, 0D))"
    assert "VectorIndexScan" not in s.explain(text) and len(ids(s.sql(text))) == 5


@pytest.mark.parametrize(("config", "kind", "metric", "function"), [
    (HnswConfig(3, 5, 5, 4, 7), "hnsw", "cosine", "cosine_distance"),
    (NswConfig(3, 5, 5), "nsw", "cosine", "cosine_distance"),
    (IvfFlatConfig(2, 2, 4, 7), "ivf_flat", "cosine", "cosine_distance"),
    (IvfPqConfig(2, 2, 4, 1, 4, 5, 7), "ivf_pq", "euclidean", "array_distance"),
])
def test_indexes_show_and_answer(spark, config, kind, metric, function):
    s = session(spark, metric, config)
    text = f"SELECT id FROM points ORDER BY {function}(embedding, array(1.0, 0.0, 0.0)) LIMIT 2"
    assert f"index={kind}" in s.explain(text) and "fetch=2" in s.explain(text)
    assert ids(s.sql(text)) == [10, 20]


def test_dot_needs_descending(spark):
    s = session(spark, "dot")
    text = "SELECT id FROM points ORDER BY inner_product(embedding, array(1.0, 0.0, 0.0)) {} LIMIT 2"
    assert "VectorIndexScan" in s.explain(text.format("DESC")) and ids(s.sql(text.format("DESC"))) == [10, 20]
    assert "VectorIndexScan" not in s.explain(text.format(""))


@pytest.mark.parametrize("text", [
    "SELECT id FROM points ORDER BY cosine_distance(array(1, 0, 0), embedding) LIMIT 2",
    "SELECT id, cosine_distance(embedding, array(1D, 0D, 0D)) AS d FROM points ORDER BY d LIMIT 2",
    "SELECT id FROM (SELECT payload, id, cosine_distance(embedding, array(1D, 0D, 0D)) AS d FROM points) ORDER BY d LIMIT 2",
    "SELECT id FROM points p ORDER BY cosine_distance(p.embedding, CAST(array(1, 0, 0) AS array<float>)) LIMIT 2",
])
def test_equivalent_shapes_are_lowered(spark, text):
    s = session(spark)
    assert "VectorIndexScan" in s.explain(text), text
    assert ids(s.sql(text)) == [10, 20]


@pytest.mark.parametrize("config", [None, IvfFlatConfig(3, 3, 8, 7), NswConfig(4, 8, 8), HnswConfig(4, 8, 8, 4, 7)])
def test_eight_points(spark, config):
    rows = [(i, [i * 1.25, 1, 1], f"point-{i}") for i in range(8)]
    s = session(spark, "euclidean", config, rows)
    top = "SELECT id, payload FROM points ORDER BY array_distance(embedding, array(1.0, 1.0, 1.0)) LIMIT {}"
    assert s.sql(top.format(3)).collect() == [(1, "point-1"), (0, "point-0"), (2, "point-2")]
    assert ids(s.sql(top.format(5))) == [1, 0, 2, 3, 4]
    assert ids(s.sql("SELECT id FROM points WHERE id >= 4 ORDER BY array_distance(embedding, array(1.0, 1.0, 1.0)) LIMIT 2")) == [4, 5]


def test_index_statements_and_methods(spark):
    s = VectorSession(spark)
    s.register("t1", VectorTable.empty_index(spark.createDataFrame([(i, [float(i), 1.0, 1.0]) for i in range(12)], "id bigint, embedding array<float>")))
    text = "SELECT id FROM t1 ORDER BY l2 LIMIT 2".replace("l2", "array_distance(array(1.0, 1.0, 1.0), embedding)")
    assert "VectorIndexScan" not in s.explain(text)
    s.sql("CREATE INDEX t1ivf ON t1 USING ivfflat (embedding vector_l2_ops) WITH (lists = 4, probe_lists = 4)")
    s.sql("CREATE INDEX t1hnsw ON t1 USING hnsw (embedding vector_l2_ops) WITH (m = 5, ef_construction = 64, ef_search = 10);")
    assert "name=t1ivf" in s.explain(text)
    for method, shown in (("hnsw", "name=t1hnsw"), ("ivfflat", "name=t1ivf"), ("none", "VectorScan: rows=12"), ("''", "name=t1ivf")):
        s.sql(f"SET vector_index_method = {method}")
        assert shown in s.explain(text)
        assert set(ids(s.sql(text))) <= {0, 1, 2}
    assert s.sql("INSERT INTO t1 VALUES (100, array(1.1, 1.0, 1.0))").collect() == [(1,)]
    assert ids(s.sql(text)) == [1, 100]
    s.sql("DROP INDEX t1ivf ON t1")
    assert "name=t1hnsw" in s.explain(text)


def test_statements_that_change_rows(spark):
    """The view, every index and exact search see the same rows."""
    s = VectorSession(spark)
    s.sql("CREATE TABLE v1 (id BIGINT, v VECTOR(3), note STRING)")
    assert s.sql("SELECT * FROM v1").count() == 0
    with pytest.raises(DimensionMismatch):
        s.sql("INSERT INTO v1 VALUES (1, array(1.0, 2.0), 'x')")
    values = ", ".join(f"({i}, array({i}.0, 1.0, 1.0), 'n{i}')" for i in range(20))
    assert s.sql(f"INSERT INTO v1 VALUES {values}").collect() == [(20,)]
    s.sql("CREATE INDEX i ON v1 USING ivfflat (v vector_l2_ops) WITH (lists = 4, probe_lists = 4)")
    s.sql("CREATE INDEX h ON v1 USING hnsw (v vector_l2_ops) WITH (m = 5)")
    near = "SELECT id FROM v1 ORDER BY array_distance(v, array(7.2, 1.0, 1.0)) LIMIT 3"
    assert "name=i" in s.explain(near) and ids(s.sql(near)) == [7, 8, 6]
    assert s.sql("DELETE FROM v1 WHERE id = 8").collect() == [(1,)]
    assert s.sql("UPDATE v1 SET v = array(7.1, 1.0, 1.0) WHERE id = 19").collect() == [(1,)]
    assert s.sql("INSERT INTO v1 (id, v) SELECT id + 100, v FROM v1 WHERE id = 7").collect() == [(1,)]
    for method in ("ivfflat", "hnsw", "none"):
        s.sql(f"SET vector_index_method = {method}")
        got = ids(s.sql(near))
        assert got[0] == 19 and {*got} == {19, 7, 107}  # 7 and 107 are equal
    s.sql("SET vector_index_method = ''")
    assert s.sql("SELECT count(*) FROM v1").first()[0] == 20 and s.tables["v1"].dataset.rows == 20
    with pytest.raises(DuplicateId):
        s.sql("INSERT INTO v1 (id, v) SELECT id, v FROM v1")


def test_filtered_search(spark):
    rows = [(i, [float(i), float(i % 7) + 1], str(i % 10)) for i in range(400)]
    for config in (None, IvfFlatConfig(8, 2, 4, 7), HnswConfig(6, 24, 16, 6, 7)):
        table = VectorTable.from_rows(spark, rows, "l2", config)
        for condition, fits in (("payload = '3'", lambda r: r[2] == "3"), ("id > 395", lambda r: r[0] > 395), ("id < 0", lambda r: False)):
            got = [r["id"] for r in table.filtered_top_k([200.3, 4.0], 5, condition).collect()]
            want = sorted((r for r in rows if fits(r)), key=lambda r: ((r[1][0] - 200.3) ** 2 + (r[1][1] - 4) ** 2, r[0]))
            assert got == [r[0] for r in want[:5]]


def test_functions(spark):
    VectorSession(spark)
    a, b = "array(1.0, 1.0, 1.0)", "array(-1.0, -1.0, -1.0)"
    got = spark.sql(f"SELECT l2_distance({a}, {b}), cosine_distance({a}, {b}), negative_inner_product({a}, {b}), inner_product({a}, {b}), array_distance({a}, NULL)").first()
    assert [round(x, 6) for x in got[:4]] == [3.464102, 2.0, 3.0, -3.0] and got[4] is None


def test_knn_join_and_top_k(spark):
    table = VectorTable.from_rows(spark, ROWS, "cosine")
    assert [r["id"] for r in table.top_k([1, 0, 0], 2).collect()] == [10, 20]
    queries = spark.createDataFrame([(1, [0.0, 1.0, 0.0])], "qid bigint, embedding array<float>")
    assert [r["row"] for r in table.knn_join(queries, 1).collect()] == [30]
