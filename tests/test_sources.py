"""Vector files, generated vectors and streams."""

import numpy as np
import pytest

from vecspark.functions.distance import Metric
from vecspark.operators.ivf import IvfFlatConfig, IvfFlatIndex
from vecspark.sources.dataset import Dataset
from vecspark.sources.vecs import read_fvecs, read_ivecs, sample, sample_queries, sample_rows
from vecspark.streaming.ingest import load_centroids, read_postings, save_centroids, stream_into


def _write(path, rows, kind):
    with open(path, "wb") as f:
        for r in rows:
            f.write(np.array([len(r)], "<i4").tobytes() + np.array(r, kind).tobytes())


def test_vecs(spark, tmp_path):
    _write(tmp_path / "a.fvecs", [[1.5, 2.5], [3.0, -4.0]], "<f4")
    _write(tmp_path / "a.ivecs", [[1, 2, 3]], "<i4")
    assert [(r["row"], r["values"]) for r in read_fvecs(spark, str(tmp_path / "a.fvecs")).orderBy("row").collect()] == [(0, [1.5, 2.5]), (1, [3.0, -4.0])]
    assert read_ivecs(spark, str(tmp_path / "a.ivecs")).first()["values"] == [1, 2, 3]
    (tmp_path / "bad.fvecs").write_bytes(np.array([3, 0, 0], "<i4").tobytes())
    with pytest.raises(Exception, match="whole number"):
        read_fvecs(spark, str(tmp_path / "bad.fvecs")).collect()


def test_samples(spark):
    rows = {r["row"]: r["embedding"] for r in sample_rows(spark, 20, 4).collect()}
    assert all(-1 <= x <= 1 for v in rows.values() for x in v) and rows[3] == [sample(3, d) for d in range(4)]
    assert np.allclose(sample_queries(1, 4)[0], np.array(rows[3]) + 0.001, atol=1e-6)


def test_stream_appends_to_lists(spark, tmp_path):
    data = Dataset.from_vectors(spark, [[v, v % 7 + 1] for v in range(40)])
    index = IvfFlatIndex(data, Metric.EUCLIDEAN, IvfFlatConfig(4, 4, 5, 7))
    save_centroids(spark, index.centroids, str(tmp_path / "centroids"))
    centroids = load_centroids(spark, str(tmp_path / "centroids"))
    assert (centroids == index.centroids).all()
    schema = "row bigint, embedding array<float>"
    for k in range(2):
        spark.createDataFrame([(100 * (k + 1) + i, [float(i), 2.0]) for i in range(5)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream_into(stream, Metric.EUCLIDEAN, centroids, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = read_postings(spark, str(tmp_path / "out"))
    assert sorted(r["row"] for r in got.collect()) == [*range(100, 105), *range(200, 205)]
    for r in got.collect():
        assert r["partition"] == int(np.argmin(((centroids - np.array(r["embedding"])) ** 2).sum(1)))
