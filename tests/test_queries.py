"""Every engine query against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import DATA, same_form

from vecspark import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, oracle, name):
    got = same_form(queries.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas())
    assert got[1], name
    assert got == oracle("sf0.001", queries.SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["nsw_topk_high_ef", "hnsw_topk_high_ef", "knn_join_cosine", "flat_topk_cosine"])
def test_parallel_vectors_rank_as_in_sql(spark, tmp_path, name):
    """Multiples and near copies of a vector are apart by rounding alone, which has to be that of the SQL."""
    draw = np.random.default_rng(3)
    base = np.array([queries.QUERY, *draw.standard_normal((9, queries.WIDTH))])
    near = [np.float32(v * k * (1 + 1e-7 * draw.standard_normal(queries.WIDTH))) for k in range(1, 6) for v in base]
    rows = [np.float32(v) * np.float32(k) for k in range(1, 16) for v in base] + near
    vectors = pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "label": pa.array([0] * len(rows), pa.int32()), "embedding": pa.array(rows, pa.list_(pa.float32()))})
    pq.write_table(vectors, tmp_path / "embeddings.parquet")
    want = duckdb.connect()
    want.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = same_form(queries.QUERIES[name](spark, str(tmp_path)).toPandas())
    assert got == same_form(want.sql(queries.SQL[name]).df())
