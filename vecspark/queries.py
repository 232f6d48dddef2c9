"""The engine's operators as queries on the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecspark.functions import distance as D
from vecspark.functions.distance import Metric
from vecspark.operators import kmeans, measure
from vecspark.operators.flat import FlatIndex
from vecspark.operators.graph import HnswConfig, HnswIndex, NswConfig, NswIndex
from vecspark.operators.ivf import IvfFlatConfig, IvfFlatIndex
from vecspark.operators.pq import IvfPqConfig, IvfPqIndex
from vecspark.plans.session import VectorSession
from vecspark.plans.table import VectorTable
from vecspark.sources.dataset import Dataset

K = 10
WIDTH = 64
#: The literal query of single searches.
QUERY = [float(np.float32(((i * 37) % 19 - 9) / 9)) for i in range(WIDTH)]
SEED = 7
IVF = IvfFlatConfig(partitions=8, probes=3, iterations=3, seed=SEED)
PQ = IvfPqConfig(partitions=8, probes=8, iterations=2, subquantizers=4, codebook_size=8, rerank=100_000, seed=SEED)
PQ_ROUND = IvfPqConfig(partitions=8, probes=8, iterations=1, subquantizers=4, codebook_size=8, rerank=32, seed=SEED)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LITERAL = f"array({', '.join(f'{x!r}D' for x in QUERY)})"
_SQL_QUERY = f"CAST([{', '.join(f'{x!r}::DOUBLE' for x in QUERY)}] AS DOUBLE[])"
_E = "CAST(embedding AS DOUBLE[])"
DISTANCE_SQL = {
    Metric.EUCLIDEAN: "list_distance({a}, {b})",
    Metric.COSINE: "least(greatest(list_cosine_distance({a}, {b}), 0), 2)",
    Metric.DOT: "-list_inner_product({a}, {b})",
}


def _distance(metric: Metric, a: str = _E, b: str = _SQL_QUERY) -> str:
    return DISTANCE_SQL[metric].format(a=a, b=b)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def named(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a table of id, payload and vector."""
    return embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("payload"), "embedding")


def dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset.of(embeddings(spark, sf_dir), "vec_id")


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every twentieth stored vector."""
    return embeddings(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def _ranked(df: DataFrame) -> DataFrame:
    """(rank, row, distance) of a single search's (row, distance); k rows at most stand in one window."""
    return df.select(F.row_number().over(Window.orderBy("distance", "row")).alias("rank"), F.col("row").alias("vec_id"), F.round(F.col("distance").cast("double"), 4).alias("distance"))


def _topk_sql(metric: Metric, where: str = "true", k: int = K) -> str:
    return f"""SELECT CAST(row_number() OVER (ORDER BY d, vec_id) AS INTEGER) AS rank, vec_id, round(CAST(d AS DOUBLE), 4) AS distance
FROM (SELECT vec_id, CAST({_distance(metric)} AS FLOAT) AS d FROM embeddings WHERE {where} ORDER BY d, vec_id LIMIT {k})"""


def _knn_sql(metric: Metric, k: int = K) -> str:
    a, b = "CAST(e.embedding AS DOUBLE[])", "CAST(q.embedding AS DOUBLE[])"
    return f"""SELECT qid, CAST(rank AS INTEGER) AS rank, vec_id, round(CAST(d AS DOUBLE), 4) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank
      FROM (SELECT q.vec_id AS qid, e.vec_id AS vec_id, CAST({_distance(metric, a, b)} AS FLOAT) AS d FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)) WHERE rank <= {k}"""


def _knn(found: DataFrame) -> DataFrame:
    return found.select("qid", "rank", F.col("row").alias("vec_id"), F.round(F.col("distance").cast("double"), 4).alias("distance"))


_SHORT = {"l2": Metric.EUCLIDEAN, "cosine": Metric.COSINE, "dot": Metric.DOT}
for _n, _m in _SHORT.items():
    named(f"flat_topk_{_n}", lambda s, d, m=_m: _ranked(FlatIndex(dataset(s, d), m).search(QUERY, K)), _topk_sql(_m))
    named(f"knn_join_{_n}", lambda s, d, m=_m: _knn(FlatIndex(dataset(s, d), m).search_batch(batch(s, d), K)), _knn_sql(_m))


# ---- plain DataFrame shapes -------------------------------------------------------------------------------------------


def _with_distance(spark: SparkSession, sf_dir: str, metric: Metric = Metric.EUCLIDEAN) -> DataFrame:
    return points(spark, sf_dir).withColumn("d", D.ranked(D.to_literal(metric, F.col("embedding"), QUERY)))


@query(f"SELECT vec_id AS id, CAST(row_number() OVER (ORDER BY CAST({_distance(Metric.EUCLIDEAN)} AS FLOAT), vec_id) AS BIGINT) AS rank FROM embeddings")
def flat_no_limit_rank(spark, sf_dir):
    """Every row's place: ranks within distance ranges, and each range's offset, so no window holds all rows."""
    parts = _with_distance(spark, sf_dir).select("id", "d").repartitionByRange("d").withColumn("p", F.spark_partition_id()).persist()
    sizes = parts.groupBy("p").count()
    earlier = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, not for each vector
    before = sizes.select("p", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    local = parts.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy("d", "id")))
    return local.join(F.broadcast(before), "p").select("id", (F.col("before") + F.col("i")).alias("rank"))


@query(f"SELECT vec_id AS id FROM (SELECT vec_id, CAST({_distance(Metric.COSINE)} AS FLOAT) AS d FROM embeddings WHERE label = 3 ORDER BY d, vec_id LIMIT {K})")
def filter_topk(spark, sf_dir):
    return _with_distance(spark, sf_dir, Metric.COSINE).where("payload = '3'").orderBy("d", "id").limit(K).select("id")


@query(f"SELECT id, payload FROM (SELECT vec_id AS id, CAST(label AS VARCHAR) AS payload, CAST({_distance(Metric.EUCLIDEAN)} AS FLOAT) AS d FROM embeddings ORDER BY round(d, 1), vec_id DESC LIMIT {K})")
def multi_key_topk(spark, sf_dir):
    return _with_distance(spark, sf_dir).orderBy(F.round(F.col("d"), 1), F.desc("id")).limit(K).select("id", "payload")


@query(f"SELECT vec_id AS id FROM (SELECT vec_id, CAST({_distance(Metric.EUCLIDEAN)} AS FLOAT) AS d FROM embeddings ORDER BY d DESC, vec_id LIMIT {K})")
def desc_topk(spark, sf_dir):
    return _with_distance(spark, sf_dir).orderBy(F.desc("d"), "id").limit(K).select("id")


@query(f"SELECT id, distance FROM (SELECT vec_id AS id, round(sqrt(list_distance({_E}, list_reverse({_E})) ** 2), 4) AS distance FROM embeddings ORDER BY distance, id LIMIT {K})")
def column_to_column_topk(spark, sf_dir):
    v = F.col("embedding")
    return points(spark, sf_dir).select("id", F.round(D.exact(Metric.EUCLIDEAN, v, F.reverse(v)), 4).alias("distance")).orderBy("distance", "id").limit(K)


@query(f"SELECT vec_id AS id, round({_distance(Metric.EUCLIDEAN)}, 4) AS l2, round({_distance(Metric.COSINE)}, 4) AS cosine, round(-({_distance(Metric.DOT)}), 4) AS product FROM embeddings")
def project_distance(spark, sf_dir):
    v = F.col("embedding")
    return points(spark, sf_dir).select("id", *[F.round(D.to_literal(m, v, QUERY) * (-1 if n == "product" else 1), 4).alias(n) for n, m in (("l2", Metric.EUCLIDEAN), ("cosine", Metric.COSINE), ("product", Metric.DOT))])


@query(f"SELECT id, round(CAST(d AS DOUBLE), 4) AS distance FROM (SELECT vec_id AS id, CAST({_distance(Metric.EUCLIDEAN)} AS FLOAT) AS d FROM embeddings) ORDER BY d, id LIMIT {K}")
def projected_alias_topk(spark, sf_dir):
    session = VectorSession(spark)
    session.register("alias_points", VectorTable(points(spark, sf_dir)))
    return session.sql(f"SELECT id, round(d, 4) AS distance FROM (SELECT id, array_distance(embedding, {LITERAL}) AS d FROM alias_points) ORDER BY d LIMIT {K}")


@query(f"SELECT label, vec_id FROM (SELECT CAST(label AS VARCHAR) AS label, vec_id, CAST({_distance(Metric.EUCLIDEAN)} AS FLOAT) AS d FROM embeddings ORDER BY d, vec_id LIMIT {K})")
def reordered_projection_topk(spark, sf_dir):
    session = VectorSession(spark)
    session.register("reordered_points", VectorTable(points(spark, sf_dir)))
    return session.sql(f"SELECT payload AS label, id AS vec_id FROM reordered_points ORDER BY array_distance({LITERAL}, embedding) LIMIT {K}")


@query(f"SELECT vec_id AS id FROM embeddings ORDER BY vec_id LIMIT {K}")
def plain_limit(spark, sf_dir):
    return points(spark, sf_dir).orderBy("id").limit(K).select("id")


@query("SELECT vec_id AS id, count(*) AS n FROM (SELECT vec_id FROM embeddings UNION ALL SELECT vec_id FROM embeddings WHERE label = 3) GROUP BY vec_id HAVING count(*) > 1")
def dup_id_check(spark, sf_dir):
    rows = points(spark, sf_dir).select("id", "payload")
    return rows.union(rows.where("payload = '3'")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT count(*) AS vectors, CAST(min(len(embedding)) AS INTEGER) AS least, CAST(max(len(embedding)) AS INTEGER) AS most FROM embeddings")
def dimension_stats(spark, sf_dir):
    return embeddings(spark, sf_dir).agg(F.count("*").alias("vectors"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"))


@query(f"SELECT vec_id, round(sqrt(list_inner_product({_E}, {_E})), 4) AS norm FROM embeddings")
def l2_norm(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", F.round(F.sqrt(D.squared_norm(F.col("embedding"))), 4).alias("norm"))


@query(f"SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos, round(CAST(CAST(x / norm AS FLOAT) AS DOUBLE), 4) + 0.0 AS value FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS pos, unnest({_E}) AS x, sqrt(list_inner_product({_E}, {_E})) AS norm FROM embeddings)")
def normalize(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", F.posexplode(D.normalized(F.col("embedding"))).alias("pos", "x")).select("vec_id", "pos", F.round(F.col("x").cast("double"), 4).alias("value"))


@query(f"WITH x AS ({_knn_sql(Metric.EUCLIDEAN)}), y AS ({_knn_sql(Metric.EUCLIDEAN)}) SELECT x.qid, count(*) FILTER (WHERE y.rank <= 5) / 10.0::DOUBLE AS recall FROM x JOIN y ON x.qid = y.qid AND x.vec_id = y.vec_id GROUP BY x.qid")
def recall_at_k(spark, sf_dir):
    """Of an answer that stops at rank 5: half of the truth."""
    truth = FlatIndex(dataset(spark, sf_dir), Metric.EUCLIDEAN).search_batch(batch(spark, sf_dir), K).persist()
    return measure.recall_at_k(truth, truth.where("rank <= 5"), K)


@query("SELECT quantile_disc(l_extendedprice, 0.0) AS p0, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.99) AS p99 FROM lineitem")
def percentile_nearest_rank(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.agg(*[measure.nearest_rank("l_extendedprice", p).alias(f"p{p}") for p in (0, 50, 99)])


# ---- k-means and the inverted file ------------------------------------------------------------------------------------

_KEY = f"md5('{SEED}:' || vec_id)"


def _lloyd(rounds: int) -> str:
    """CTEs c0..c<rounds> (p, centroid) and a0..a<rounds> (vec_id, p, embedding)."""
    out = [f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY {_KEY}, vec_id) - 1 AS INTEGER) AS p, embedding AS centroid FROM embeddings ORDER BY {_KEY}, vec_id LIMIT {IVF.partitions})"]
    for i in range(rounds + 1):
        near = _distance(Metric.EUCLIDEAN, "CAST(e.embedding AS DOUBLE[])", "CAST(c.centroid AS DOUBLE[])")
        out.append(f"a{i} AS (SELECT vec_id, embedding, p FROM (SELECT e.vec_id, e.embedding, c.p, row_number() OVER (PARTITION BY e.vec_id ORDER BY CAST({near} AS FLOAT), c.p) AS r FROM embeddings e, c{i} c) WHERE r = 1)")
        if i < rounds:
            out.append(f"c{i + 1} AS (SELECT p, list(CAST(m AS FLOAT) ORDER BY pos) AS centroid FROM (SELECT p, pos, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT p, unnest(range(1, {WIDTH + 1})) AS pos, unnest(embedding) AS x FROM a{i}) GROUP BY p, pos) GROUP BY p)")
    return ", ".join(out)


def _ivf(spark: SparkSession, sf_dir: str) -> IvfFlatIndex:
    return IvfFlatIndex(dataset(spark, sf_dir), Metric.EUCLIDEAN, IVF)


@query(f"SELECT vec_id AS row FROM embeddings ORDER BY {_KEY}, vec_id LIMIT {IVF.partitions}")
def kmeans_seed_rows(spark, sf_dir):
    return kmeans.seed_rows(dataset(spark, sf_dir).df, SEED, IVF.partitions).select("row")


def _seeds(data: Dataset) -> np.ndarray:
    return np.array([r["embedding"] for r in kmeans.seed_rows(data.df, SEED, IVF.partitions).collect()], np.float32)


@query(f"WITH {_lloyd(0)} SELECT vec_id AS row, p AS partition FROM a0")
def kmeans_assign(spark, sf_dir):
    data = dataset(spark, sf_dir)
    return kmeans.assigned(data, Metric.EUCLIDEAN, _seeds(data)).select("row", "partition")


def _centroid_rows(table: DataFrame) -> DataFrame:
    return table.select("partition", F.posexplode("centroid").alias("pos", "x")).select("partition", "pos", F.round(F.col("x").cast("double"), 4).alias("value"))


def _centroid_sql(rounds: int) -> str:
    return f"WITH {_lloyd(rounds)} SELECT p AS partition, CAST(pos - 1 AS INTEGER) AS pos, round(CAST(x AS DOUBLE), 4) + 0.0 AS value FROM (SELECT p, unnest(range(1, {WIDTH + 1})) AS pos, unnest(centroid) AS x FROM c{rounds})"


@query(_centroid_sql(1))
def kmeans_update(spark, sf_dir):
    data = dataset(spark, sf_dir)
    centroids = kmeans.train(data, Metric.EUCLIDEAN, IVF.partitions, 1, SEED)
    return _centroid_rows(spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "partition int, centroid array<float>"))


@query(_centroid_sql(IVF.iterations))
def ivf_centroids(spark, sf_dir):
    return _centroid_rows(_ivf(spark, sf_dir).centroid_table())


@query(f"WITH {_lloyd(IVF.iterations)} SELECT c.p AS partition, count(a.p) AS rows FROM c{IVF.iterations} c LEFT JOIN a{IVF.iterations} a ON a.p = c.p GROUP BY c.p")
def ivf_list_sizes(spark, sf_dir):
    return _ivf(spark, sf_dir).list_sizes()


@query(f"""WITH {_lloyd(IVF.iterations)},
l AS (SELECT p FROM c{IVF.iterations} ORDER BY CAST({_distance(Metric.EUCLIDEAN, "CAST(centroid AS DOUBLE[])")} AS FLOAT), p LIMIT {IVF.probes})
SELECT CAST(row_number() OVER (ORDER BY d, vec_id) AS INTEGER) AS rank, vec_id, round(CAST(d AS DOUBLE), 4) AS distance
FROM (SELECT vec_id, CAST({_distance(Metric.EUCLIDEAN)} AS FLOAT) AS d FROM a{IVF.iterations} WHERE p IN (SELECT p FROM l) ORDER BY d, vec_id LIMIT {K})""")
def ivf_topk_probed(spark, sf_dir):
    return _ranked(_ivf(spark, sf_dir).search(QUERY, K))


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that aren't stored rows: every twentieth vector, reversed."""
    return embeddings(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.reverse("embedding").alias("embedding"))


def _recall_sql() -> str:
    """CTEs truth and found (qid, vec_id, rank): exact, and from the lists that a query probes."""
    q = "SELECT vec_id AS qid, CAST(list_reverse(embedding) AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0"
    near = "CAST(list_distance(CAST({} AS DOUBLE[]), q.v) AS FLOAT)"
    return f"""WITH {_lloyd(IVF.iterations)}, q AS ({q}),
lists AS (SELECT qid, v, p FROM (SELECT q.qid, q.v, c.p, row_number() OVER (PARTITION BY qid ORDER BY {near.format("c.centroid")}, c.p) AS r FROM q, c{IVF.iterations} c) WHERE r <= {IVF.probes}),
truth AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY {near.format("e.embedding")}, vec_id) AS rank FROM q, embeddings e QUALIFY rank <= {K}),
found AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY {near.format("a.embedding")}, vec_id) AS rank FROM lists q JOIN a{IVF.iterations} a ON a.p = q.p QUALIFY rank <= {K})"""


@query(f"{_recall_sql()} SELECT t.qid, count(f.vec_id) / {K}.0::DOUBLE AS recall FROM truth t LEFT JOIN found f ON f.qid = t.qid AND f.vec_id = t.vec_id GROUP BY t.qid")
def ivf_recall_at_k(spark, sf_dir):
    """What share of each query's true nearest the probed lists give."""
    truth = FlatIndex(dataset(spark, sf_dir), Metric.EUCLIDEAN).search_batch(_shifted(spark, sf_dir), K)
    return measure.recall_at_k(truth, _ivf(spark, sf_dir).search_batch(_shifted(spark, sf_dir), K), K)


@query(f"{_recall_sql()} SELECT count(f.vec_id) / count(*)::DOUBLE AS recall FROM truth t LEFT JOIN found f ON f.qid = t.qid AND f.vec_id = t.vec_id AND f.rank <= 5 WHERE t.rank = 1")
def recall_1nn_at_r(spark, sf_dir):
    """The share of queries whose true nearest row is among the first five from the probed lists."""
    truth = FlatIndex(dataset(spark, sf_dir), Metric.EUCLIDEAN).search_batch(_shifted(spark, sf_dir), K)
    return measure.recall_1nn_at_r(truth, _ivf(spark, sf_dir).search_batch(_shifted(spark, sf_dir), K), 5)


@query(_knn_sql(Metric.EUCLIDEAN))
def ivf_topk_all_probes(spark, sf_dir):
    return _knn(_ivf(spark, sf_dir).search_batch(batch(spark, sf_dir), K, IVF.partitions))


@query(f"""WITH {_lloyd(IVF.iterations)},
n AS (SELECT vec_id + 1000000 AS vec_id, list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) * 0.5 AS FLOAT)) AS embedding FROM embeddings),
b AS (SELECT p, vec_id FROM (SELECT n.vec_id, c.p, row_number() OVER (PARTITION BY n.vec_id ORDER BY CAST(list_distance(CAST(n.embedding AS DOUBLE[]), CAST(c.centroid AS DOUBLE[])) AS FLOAT), c.p) AS r FROM n, c{IVF.iterations} c) WHERE r = 1)
SELECT p AS partition, count(*) AS rows FROM (SELECT p FROM a{IVF.iterations} UNION ALL SELECT p FROM b) GROUP BY p""")
def ivf_insert(spark, sf_dir):
    index = _ivf(spark, sf_dir)
    new = embeddings(spark, sf_dir).select((F.col("vec_id") + 1000000).alias("row"), F.transform("embedding", lambda x: (x.cast("double") * 0.5).cast("float")).alias("embedding"))
    index.insert(new)
    return index.list_sizes().where("rows > 0")


# ---- product quantisation ---------------------------------------------------------------------------------------------


def _residual_sql(rounds: int) -> str:
    """CTE res (vec_id, p, pos from 0, x): against the centroids after these rounds."""
    near = "list_sum(list_transform(list_zip(e.embedding, c.centroid), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2))"
    return f"""{_lloyd(rounds)},
near AS (SELECT vec_id, p, embedding, centroid FROM (SELECT e.vec_id, c.p, e.embedding, c.centroid, row_number() OVER (PARTITION BY e.vec_id ORDER BY {near}, c.p) AS r FROM embeddings e, c{rounds} c) WHERE r = 1),
res AS (SELECT vec_id, p, pos - 1 AS pos, CAST(CAST(a AS DOUBLE) - CAST(b AS DOUBLE) AS FLOAT) AS x FROM (SELECT vec_id, p, unnest(range(1, {WIDTH + 1})) AS pos, unnest(embedding) AS a, unnest(centroid) AS b FROM near))"""


def _codes_sql(tail: str = "SELECT vec_id AS row, string_agg(CAST(k AS VARCHAR), ',' ORDER BY m) AS codes FROM g1 GROUP BY vec_id") -> str:
    width = WIDTH // PQ_ROUND.subquantizers

    def codes(book: str) -> str:
        return f"SELECT vec_id, m, k FROM (SELECT vec_id, m, k, row_number() OVER (PARTITION BY vec_id, m ORDER BY d, k) AS r FROM (SELECT s.vec_id, s.m, b.k, sum((CAST(s.x AS DOUBLE) - CAST(b.x AS DOUBLE)) ** 2) AS d FROM sl s JOIN {book} b ON b.m = s.m AND b.pos = s.pos GROUP BY 1, 2, 3)) WHERE r = 1"

    return f"""WITH {_residual_sql(1)},
sl AS (SELECT vec_id, pos // {width} AS m, pos % {width} AS pos, x FROM res),
pick AS (SELECT m, vec_id, row_number() OVER (PARTITION BY m ORDER BY md5('{SEED}:' || m || ':' || vec_id), vec_id) - 1 AS k FROM (SELECT DISTINCT m, vec_id FROM sl) QUALIFY k < {PQ_ROUND.codebook_size}),
b0 AS (SELECT sl.m, pick.k, sl.pos, sl.x FROM pick JOIN sl ON sl.m = pick.m AND sl.vec_id = pick.vec_id),
g0 AS ({codes("b0")}),
u0 AS (SELECT sl.m, g0.k, sl.pos, CAST(avg(CAST(sl.x AS DOUBLE)) AS FLOAT) AS x FROM sl JOIN g0 ON g0.vec_id = sl.vec_id AND g0.m = sl.m GROUP BY 1, 2, 3),
b1 AS (SELECT b0.m, b0.k, b0.pos, coalesce(u0.x, b0.x) AS x FROM b0 LEFT JOIN u0 ON u0.m = b0.m AND u0.k = b0.k AND u0.pos = b0.pos),
g1 AS ({codes("b1")})
{tail}"""


@query(f"WITH {_residual_sql(PQ.iterations)} SELECT vec_id AS row, p AS partition, round(sqrt(sum(CAST(x AS DOUBLE) ** 2)), 4) AS norm FROM res GROUP BY 1, 2")
def pq_residuals(spark, sf_dir):
    index = IvfPqIndex(dataset(spark, sf_dir), Metric.EUCLIDEAN, PQ)
    return index.residuals.select("row", "partition", F.round(F.sqrt(D.squared_norm(F.col("residual"))), 4).alias("norm"))


@query(_codes_sql())
def pq_codes(spark, sf_dir):
    index = IvfPqIndex(dataset(spark, sf_dir), Metric.EUCLIDEAN, PQ_ROUND)
    return index.codes.select("row", F.concat_ws(",", F.transform("codes", lambda x: x.cast("string"))).alias("codes"))


def _shortlist_sql() -> str:
    """Each query against every list's centroid, that rest against the codewords, and by them the rows' sums."""
    width = WIDTH // PQ_ROUND.subquantizers
    qx = f"SELECT qid, pos - 1 AS pos, x FROM (SELECT vec_id AS qid, unnest(range(1, {WIDTH + 1})) AS pos, unnest(list_reverse(embedding)) AS x FROM embeddings WHERE vec_id % 20 = 0)"
    cx = f"SELECT p, pos - 1 AS pos, x FROM (SELECT p, unnest(range(1, {WIDTH + 1})) AS pos, unnest(centroid) AS x FROM c1)"
    return _codes_sql(f"""SELECT qid, CAST(rank AS INTEGER) AS rank, round(approx, 4) AS approx FROM (SELECT qid, approx, row_number() OVER (PARTITION BY qid ORDER BY approx, vec_id) AS rank FROM (
SELECT t.qid, g.vec_id, sum(t.d) AS approx FROM g1 g JOIN (SELECT DISTINCT vec_id, p FROM res) l ON l.vec_id = g.vec_id JOIN (
SELECT qid, p, b.m, b.k, sum((r - CAST(b.x AS DOUBLE)) ** 2) AS d FROM (SELECT q.qid, c.p, q.pos, CAST(q.x AS DOUBLE) - CAST(c.x AS DOUBLE) AS r FROM ({qx}) q JOIN ({cx}) c ON c.pos = q.pos) z
JOIN b1 b ON b.m = z.pos // {width} AND b.pos = z.pos % {width} GROUP BY 1, 2, 3, 4) t ON t.p = l.p AND t.m = g.m AND t.k = g.k GROUP BY 1, 2)) WHERE rank <= {PQ_ROUND.rerank}""")


@query(_shortlist_sql())
def pq_shortlist(spark, sf_dir):
    """By the codes alone, each query's nearest rows of all lists; equal codes tie, so rows are shown by their sums."""
    index = IvfPqIndex(dataset(spark, sf_dir), Metric.EUCLIDEAN, PQ_ROUND)
    queries = _shifted(spark, sf_dir).orderBy("qid").collect()
    found = index.shortlist(np.array([r["qid"] for r in queries]), np.array([r["embedding"] for r in queries], np.float32), PQ_ROUND.rerank, PQ_ROUND.probes)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("approx", "row"))
    return found.select("qid", rank.alias("rank"), F.round("approx", 4).alias("approx"))


@query(f"SELECT count(*) * {PQ.subquantizers} AS codes, CAST({PQ.codebook_size * WIDTH * 4} AS BIGINT) AS codebooks, count(*) * {WIDTH * 4} AS full_vectors FROM embeddings")
def pq_bytes(spark, sf_dir):
    index = IvfPqIndex(dataset(spark, sf_dir), Metric.EUCLIDEAN, PQ_ROUND)
    return spark.createDataFrame([(index.encoded_bytes(), index.codebook_bytes(), index.full_precision_bytes())], "codes bigint, codebooks bigint, full_vectors bigint")


@query(_knn_sql(Metric.EUCLIDEAN))
def pq_topk_full(spark, sf_dir):
    """All lists and a rerank of every row: exact."""
    data = dataset(spark, sf_dir)
    return _knn(IvfPqIndex(data, Metric.EUCLIDEAN, PQ).search_batch(batch(spark, sf_dir), K, rerank=data.rows))


# ---- graphs -----------------------------------------------------------------------------------------------------------

NSW, HNSW = NswConfig(12, 48, 32), HnswConfig(12, 64, 40, 8, SEED)


@query(_knn_sql(Metric.COSINE))
def nsw_topk_high_ef(spark, sf_dir):
    """A beam as wide as the table is exact on a connected graph."""
    data = dataset(spark, sf_dir)
    return _knn(NswIndex(data, Metric.COSINE, NSW).search_batch(batch(spark, sf_dir), K, data.rows))


@query(_knn_sql(Metric.COSINE))
def hnsw_topk_high_ef(spark, sf_dir):
    data = dataset(spark, sf_dir)
    return _knn(HnswIndex(data, Metric.COSINE, HNSW).search_batch(batch(spark, sf_dir), K, data.rows))


@query("SELECT count(*) AS vectors, CAST(0 AS BIGINT) AS over_cap, CAST(0 AS BIGINT) AS one_way FROM embeddings")
def nsw_degree_cap(spark, sf_dir):
    """No row has more edges than the cap, and every edge is there at both ends."""
    edges = NswIndex(dataset(spark, sf_dir), Metric.EUCLIDEAN, NSW).adjacency().persist()
    ends = edges.select("row", F.explode("neighbors").alias("other"))
    one_way = ends.join(ends.select(F.col("other").alias("a"), F.col("row").alias("b")), (F.col("row") == F.col("a")) & (F.col("other") == F.col("b")), "left_anti").count()
    return edges.agg(F.count("*").alias("vectors"), F.count(F.when(F.size("neighbors") > NSW.max_connections, 1)).alias("over_cap")).withColumn("one_way", F.lit(one_way).cast("bigint"))


@query(f"""SELECT vec_id AS row, CAST(least({HNSW.max_level}, 4 * f + CASE WHEN c IN ('8', '9', 'a', 'b') THEN 1 WHEN c IN ('c', 'd') THEN 2 WHEN c = 'e' THEN 3 ELSE 0 END) AS INTEGER) AS level
FROM (SELECT vec_id, f, substring(h, f + 1, 1) AS c FROM (SELECT vec_id, h, 32 - length(ltrim(h, 'f')) AS f FROM (SELECT vec_id, {_KEY} AS h FROM embeddings)))""")
def hnsw_levels(spark, sf_dir):
    return HnswIndex(dataset(spark, sf_dir), Metric.COSINE, HNSW).levels()


# ---- SQL --------------------------------------------------------------------------------------------------------------


def _session(spark: SparkSession, sf_dir: str, name: str, metric: Metric, config: object = None) -> VectorSession:
    session = VectorSession(spark)
    session.register(name, VectorTable(points(spark, sf_dir), metric, config))
    return session


@query(f"SELECT vec_id AS id, CAST(label AS VARCHAR) AS payload FROM (SELECT vec_id, label, CAST({_distance(Metric.COSINE)} AS FLOAT) AS d FROM embeddings ORDER BY d, vec_id LIMIT {K})")
def sql_index_topk(spark, sf_dir):
    """Through an inverted file with all lists probed."""
    config = IvfFlatConfig(8, 8, 3, SEED)
    return _session(spark, sf_dir, "sql_points", Metric.COSINE, config).sql(f"SELECT id, payload FROM sql_points ORDER BY cosine_distance(embedding, {LITERAL}) LIMIT {K}")


@query(f"SELECT vec_id AS id FROM (SELECT vec_id, CAST({_distance(Metric.DOT)} AS FLOAT) AS d FROM embeddings ORDER BY d, vec_id LIMIT {K})")
def sql_ordered_topk(spark, sf_dir):
    session = _session(spark, sf_dir, "ordered_points", Metric.DOT)
    session.sql("SET vector_search.ordered = true")
    try:
        return session.sql(f"SELECT id FROM ordered_points ORDER BY inner_product(embedding, {LITERAL}) DESC LIMIT {K}")
    finally:
        session.sql("SET vector_search.ordered = false")


@query(f"SELECT vec_id AS id FROM (SELECT vec_id, {_distance(Metric.COSINE)} AS d FROM embeddings WHERE label <> 3 ORDER BY d, vec_id LIMIT {K})")
def sql_filter_fallback(spark, sf_dir):
    return _session(spark, sf_dir, "filtered_points", Metric.COSINE).sql(f"SELECT id FROM filtered_points WHERE payload <> '3' ORDER BY cosine_distance(embedding, {LITERAL}) LIMIT {K}")


# ---- the platform: what a query can put around vector search ----------------------------------------------------------


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def smoke_join(spark, sf_dir):
    joined = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def smoke_semi_anti_join(spark, sf_dir):
    customer, orders = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    on = F.col("o_custkey") == F.col("c_custkey")
    return customer.join(orders, on, "left_semi").select("c_custkey", F.lit(True).alias("has_orders")).union(customer.join(orders, on, "left_anti").select("c_custkey", F.lit(False)))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(avg(l_discount), 6) AS discount, count(*) AS lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def smoke_groupby(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("lines"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS lines FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def smoke_rollup(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("lines"))


@query("SELECT o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def smoke_window(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", rank.alias("rank")).where("rank <= 2")


@query("SELECT k FROM ((SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation) INTERSECT SELECT o_custkey FROM orders")
def smoke_setops(spark, sf_dir):
    customer, supplier, nation, orders = (_t(spark, sf_dir, n).select(F.col(c).cast("bigint").alias("k")) for n, c in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("orders", "o_custkey")))
    return customer.union(supplier).distinct().subtract(nation).intersect(orders)


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, upper(substring(o_orderpriority, 1, 3)) AS priority FROM orders WHERE o_orderpriority LIKE '%H%'")
def smoke_string_date(spark, sf_dir):
    return _t(spark, sf_dir, "orders").where(F.col("o_orderpriority").like("%H%")).select("o_orderkey", F.year("o_orderdate").alias("year"), F.upper(F.substring("o_orderpriority", 1, 3)).alias("priority"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: an exact cosine top-k."""
    return QUERIES["flat_topk_cosine"](spark, sf_dir)
