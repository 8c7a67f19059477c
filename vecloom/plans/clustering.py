"""Queries of clustering operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.durable import new_path
from vecloom.functions.vectors import l1_ball, l1_norm, sq_dist, sq_norm
from vecloom.operators import dense, lloyd, prepare, sparse_points
from vecloom.operators.factorized_kmeans import factorized_after_kmeans, factorized_kmeans
from vecloom.operators.positions import with_prefix_sum
from vecloom.plans.registry import COORDINATES, POINTS, assigned, averaged, first_centroids, gaussian, plus_plus, projected, query, sq, text
from vecloom.plans.registry import lloyd as lloyd_sql
from vecloom.plans.registry import uniform as uniform_sql
from vecloom.sources import raw
from vecloom.sources.tables import feature_points, first_rows, load, points
from vecloom.streaming.running_means import RunningMeans, cluster_stream

K = 8


def rounded(c: str, digits: int = 6):
    return (F.round(c, digits) + 0.0).alias(c)


def coordinates(spark: SparkSession, u: np.ndarray) -> DataFrame:
    rows = [(k, i, float(v)) for k, row in enumerate(u) for i, v in enumerate(row)]
    return spark.createDataFrame(rows, "k int, pos int, value double").withColumn("value", F.round("value", 6) + 0.0)


def centroid_table(spark: SparkSession, u: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(u)], "k int, u array<double>")


@query(f"WITH {POINTS} SELECT id, round(list_sum(list_transform(x, lambda v: v * v)), 6) AS sq_norm FROM p")
def row_sq_norms(spark, sf_dir):
    return points(spark, sf_dir).select("id", F.round(sq_norm(F.col("x")), 6).alias("sq_norm"))


@query("SELECT l_orderkey AS id, l_linenumber AS line, round(l_quantity * l_quantity + l_extendedprice * l_extendedprice + l_discount * l_discount + l_tax * l_tax, 4) AS sq_norm FROM lineitem")
def row_sq_norms_wide(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("x"))
    return rows.select("id", "line", F.round(sq_norm(F.col("x")), 4).alias("sq_norm"))


@query(f"WITH {POINTS}, {first_centroids(K)} SELECT p.id, CAST(c0.k AS INTEGER) AS k, round({sq('p.x', 'c0.u')}, 6) AS d2 FROM p, c0")
def pairwise_distances(spark, sf_dir):
    pts = points(spark, sf_dir)
    return dense.distances(pts, centroid_table(spark, first_rows(pts, K))).select("id", "k", rounded("d2"))


@query(f"WITH {POINTS}, {first_centroids(K)}, {assigned('a', 'c0')} SELECT id, CAST(k AS INTEGER) AS k, round(d, 6) AS d2 FROM a")
def nearest_centroid(spark, sf_dir):
    pts = points(spark, sf_dir)
    return dense.assign(pts, first_rows(pts, K)).select("id", "k", rounded("d2"))


@query(f"WITH {POINTS}, {first_centroids(K)}, {assigned('a', 'c0')} SELECT id, CAST(k AS INTEGER) AS k, round(d, 6) AS d2 FROM a")
def nearest_centroid_native(spark, sf_dir):
    pts = points(spark, sf_dir)
    return dense.assign_native(pts, first_rows(pts, K)).select("id", "k", rounded("d2"))


@query(
    f"WITH {POINTS}, {first_centroids(K)}, s AS (SELECT p.id, c0.k, list_sum(list_transform(u, lambda v: v * v)) - 2 * list_sum(list_transform(list_zip(u, x), lambda z: z[1] * z[2])) AS score FROM p, c0) "
    "SELECT id, CAST(k AS INTEGER) AS k, round(score, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score, k) AS r FROM s) WHERE r = 1"
)
def operator_assign(spark, sf_dir):
    pts = points(spark, sf_dir)
    return dense.operator_scores(pts, first_rows(pts, K)).select("id", "k", rounded("score"))


@query(f"WITH {POINTS}, {first_centroids(12)}, {assigned('a', 'c0')} SELECT CAST(c0.k AS INTEGER) AS k, count(a.id) AS n FROM c0 LEFT JOIN a ON a.k = c0.k GROUP BY c0.k")
def assign_counts(spark, sf_dir):
    pts = points(spark, sf_dir)
    counts = dense.assign(pts, first_rows(pts, 12)).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(12).select(F.col("id").cast("int").alias("k"))
    return every.join(counts, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {POINTS}, {first_centroids(K)}, {assigned('a', 'c0')} SELECT round(sum(d), 6) AS objective, count(*) AS n FROM a")
def objective(spark, sf_dir):
    pts = points(spark, sf_dir)
    return dense.assign(pts, first_rows(pts, K)).agg(F.round(F.sum("d2"), 6).alias("objective"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {POINTS}, {first_centroids(K)}, {assigned('a', 'c0')} SELECT a.id, CAST(a.k AS INTEGER) AS k, round({sq('a.x', 'c0.u')}, 6) AS d2, round(c0.u[1], 6) AS first FROM a JOIN c0 ON a.k = c0.k")
def gather_centroids(spark, sf_dir):
    pts = points(spark, sf_dir)
    table = centroid_table(spark, first_rows(pts, K))
    joined = dense.assign(pts, first_rows(pts, K), keep=("id", "x")).drop("d2").join(F.broadcast(table), "k")
    return joined.select("id", "k", F.round(sq_dist(F.col("x"), F.col("u")), 6).alias("d2"), F.round(F.col("u")[0], 6).alias("first"))


@query(f"WITH {POINTS}, {first_centroids(K)}, {assigned('a', 'c0')}, {averaged('m', 'a')} " + COORDINATES.format("m"))
def centroid_means(spark, sf_dir):
    pts = points(spark, sf_dir)
    found = dense.means(dense.assign(pts, first_rows(pts, K), keep=("id", "x")))
    return found.select("k", "pos", rounded("value"))


@query(lloyd_sql(K, 1) + "\n" + COORDINATES.format("c1"))
def lloyd_1(spark, sf_dir):
    pts = points(spark, sf_dir)
    return coordinates(spark, lloyd.kmeans(pts, first_rows(pts, K), max_iter=1).centroids)


@query(lloyd_sql(K, 3) + "\n" + COORDINATES.format("c3"))
def lloyd_3(spark, sf_dir):
    pts = points(spark, sf_dir)
    return coordinates(spark, lloyd.kmeans(pts, first_rows(pts, K), max_iter=3, delta=0.0).centroids)


_TRACE = " UNION ALL ".join(
    f"SELECT {i} AS iter, round((SELECT sum(d) FROM a{i}), 6) AS objective_at_assign, round((SELECT sum({sq('a.x', 'c.u')}) FROM a{i} a JOIN c{i + 1} c ON a.k = c.k), 6) AS objective_after_update"
    for i in range(3)
)


@query(lloyd_sql(K, 3) + "\n" + _TRACE)
def lloyd_trace(spark, sf_dir):
    pts = points(spark, sf_dir)
    trace = lloyd.kmeans(pts, first_rows(pts, K), max_iter=3, delta=0.0).trace
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(trace)], "iter int, objective_at_assign double, objective_after_update double")
    return rows.select("iter", rounded("objective_at_assign"), rounded("objective_after_update"))


@query(lloyd_sql(K, 2) + "\n" + COORDINATES.format("c2"))
def minibatch_epochs(spark, sf_dir):
    pts = points(spark, sf_dir)
    return coordinates(spark, lloyd.minibatch_kmeans(pts, first_rows(pts, K), max_iter=2, delta=0.0).centroids)


_HALVES = f"""WITH {POINTS}, {first_centroids(K)}, {assigned('a', 'c0')},
h AS (SELECT k, id % 2 AS half, count(*) AS n, 0 AS z FROM a GROUP BY 1, 2),
m AS (SELECT k, half, i, avg(v) AS m FROM (SELECT k, id % 2 AS half, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM a) GROUP BY 1, 2, 3)
SELECT CAST(m.k AS INTEGER) AS k, CAST(m.i AS INTEGER) AS pos, CAST(sum(h.n) AS BIGINT) AS n, round(sum(m.m * h.n) / sum(h.n), 6) + 0.0 AS value
FROM m JOIN h ON m.k = h.k AND m.half = h.half GROUP BY m.k, m.i"""


@query(_HALVES)
def weighted_merge_means(spark, sf_dir):
    pts = points(spark, sf_dir)
    placed = dense.assign(pts, first_rows(pts, K), keep=("id", "x"))

    def half(r: int) -> DataFrame:
        long = dense.means(placed.filter(F.col("id") % 2 == r))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"])
        return long.groupBy("k").agg(F.max("n").alias("n"), ordered.alias("u"))

    merged = dense.merge_means(half(0), half(1))
    return merged.select("k", "n", F.posexplode("u").alias("pos", "value")).select("k", "pos", "n", rounded("value"))


def _duplicated(pts: DataFrame) -> np.ndarray:
    """Eight centroids of which the fourth repeats the first: ties go to the lower, so the fourth is empty."""
    u = first_rows(pts, K)
    u[3] = u[0]
    return u


_DUP = f"WITH {POINTS}, c0 AS (SELECT id AS k, x AS u FROM p WHERE id < {K} AND id <> 3 UNION ALL SELECT 3, x FROM p WHERE id = 0), {assigned('a', 'c0')}"
_FAR = f"""{_DUP},
big AS (SELECT k FROM (SELECT k, count(*) AS n FROM a GROUP BY k) ORDER BY n DESC, k LIMIT 1),
far AS (SELECT a.id FROM a JOIN big ON a.k = big.k, (SELECT u FROM c0 WHERE k = 3) o ORDER BY {sq('a.x', 'o.u')} DESC, a.id LIMIT 1),
b AS (SELECT id, x, CASE WHEN id = (SELECT id FROM far) THEN 3 ELSE k END AS k FROM a),
{averaged('m', 'b')} """


@query(_FAR + COORDINATES.format("m"))
def empty_cluster_farthest(spark, sf_dir):
    pts = points(spark, sf_dir)
    return coordinates(spark, lloyd.kmeans(pts, _duplicated(pts), max_iter=1, empty="farthest").centroids)


@query(f"{_DUP}, {averaged('n', 'a')}, m AS (SELECT k, u FROM n UNION ALL SELECT 3, list_transform(x, lambda v: 0.0::DOUBLE) FROM p WHERE id = 0) " + COORDINATES.format("m"))
def empty_cluster_zero(spark, sf_dir):
    pts = points(spark, sf_dir)
    return coordinates(spark, lloyd.kmeans(pts, _duplicated(pts), max_iter=1, empty="zero").centroids)


@query(f"{_DUP} SELECT CAST(c0.k AS INTEGER) AS k, CAST(greatest(count(a.id), 1) AS BIGINT) - CASE WHEN c0.k = (SELECT k FROM (SELECT k, count(*) AS n FROM a GROUP BY k) ORDER BY n DESC, k LIMIT 1) THEN 1 ELSE 0 END AS n FROM c0 LEFT JOIN a ON a.k = c0.k GROUP BY c0.k")
def empty_cluster_random_counts(spark, sf_dir):
    pts = points(spark, sf_dir)
    counts = lloyd.kmeans(pts, _duplicated(pts), max_iter=1, empty="random", seed=5).counts
    return spark.createDataFrame([(k, int(n)) for k, n in enumerate(counts)], "k int, n long")


_L1 = """s AS (SELECT id, x, list_sum(list_transform(x, lambda v: abs(v))) AS n FROM p),
o AS (SELECT id, m, sum(m) OVER w AS cum, row_number() OVER w AS r FROM (SELECT id, abs(unnest(x)) AS m FROM p) WINDOW w AS (PARTITION BY id ORDER BY m DESC ROWS UNBOUNDED PRECEDING)),
t AS (SELECT id, greatest(max((cum - 2.0) / r), 0) AS t FROM o GROUP BY id)"""


@query(
    f"WITH {POINTS}, {_L1} SELECT id, CAST(i AS INTEGER) AS pos, round(CASE WHEN n <= 2.0 THEN v ELSE sign(v) * greatest(abs(v) - t, 0) END, 6) + 0.0 AS value "
    "FROM (SELECT s.id, n, t, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM s JOIN t ON s.id = t.id)"
)
def l1_ball_projection(spark, sf_dir):
    pts = points(spark, sf_dir)
    return pts.select("id", F.posexplode(l1_ball(F.col("x"), 2.0)).alias("pos", "value")).select("id", "pos", rounded("value"))


_LLOYD_L1 = ",\n".join([f"WITH {POINTS}, {first_centroids(K)}"] + [f"{assigned(f'a{i}', f'c{i}')}, {averaged(f'm{i}', f'a{i}')}, {projected(f'c{i + 1}', f'm{i}', 2.0)}" for i in range(3)])


@query(_LLOYD_L1 + "\nSELECT CAST(k AS INTEGER) AS k, round(list_sum(list_transform(u, lambda v: abs(v))), 6) AS l1, CAST(len(list_filter(u, lambda v: abs(v) > 1e-12)) AS INTEGER) AS non_zeros FROM c3")
def lloyd_l1(spark, sf_dir):
    pts = points(spark, sf_dir)
    model = lloyd.kmeans(pts, first_rows(pts, K), max_iter=3, delta=0.0, l1_radius=2.0)
    table = centroid_table(spark, model.centroids)
    return table.select("k", F.round(l1_norm(F.col("u")), 6).alias("l1"), F.size(F.filter("u", lambda v: F.abs(v) > 1e-12)).alias("non_zeros"))


@query("SELECT vec_id AS id FROM (SELECT vec_id, row_number() OVER (ORDER BY md5('3:' || CAST(vec_id AS VARCHAR)), vec_id) AS r FROM embeddings) WHERE r <= 10")
def uniform_init(spark, sf_dir):
    key = F.md5(F.concat(F.lit("3:"), F.col("id").cast("string")).cast("binary"))
    return points(spark, sf_dir).orderBy(key, "id").limit(10).select("id")


@query("SELECT id FROM (SELECT i AS id, row_number() OVER (ORDER BY md5('9:' || CAST(i AS VARCHAR))) AS r FROM (SELECT unnest(range(0, 100)) AS i)) WHERE r <= 7 ORDER BY id")
def random_combination(spark, sf_dir):
    """A sorted 7-combination of 0..99, by hash order."""
    key = F.md5(F.concat(F.lit("9:"), F.col("id").cast("string")).cast("binary"))
    return spark.range(100).orderBy(key).limit(7).orderBy("id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (ORDER BY md5('4:' || CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR)), l_orderkey, l_linenumber) <= 200")
def evaluation_subsample(spark, sf_dir):
    """A fixed number of rows uniformly at random: the limit is the operator. Each task keeps its first 200."""
    key = F.md5(F.concat(F.lit("4:"), F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")).cast("binary"))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").orderBy(key, "l_orderkey", "l_linenumber").limit(200)


@query(plus_plus(6, 1) + "\nSELECT CAST(n AS INTEGER) AS k, CAST(i AS INTEGER) AS pos, round(v, 6) + 0.0 AS value FROM (SELECT n, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM x6)")
def kmeanspp_init(spark, sf_dir):
    pts = points(spark, sf_dir)
    return coordinates(spark, lloyd.plus_plus(pts, 6, seed=1))


@query(
    f"WITH {POINTS}, c0 AS (SELECT id AS k, x AS u FROM p WHERE id < 3), {assigned('a', 'c0')}, "
    "s AS (SELECT id, d, sum(d) OVER (ORDER BY id) AS cum, sum(d) OVER () AS total FROM a) SELECT min(id) AS id, round(max(total), 6) AS total FROM s WHERE cum >= total * 0.375"
)
def prefix_sum_draw(spark, sf_dir):
    """The row at the quantile 0.375 of the squared distances, by prefix sums over ranges of ids."""
    pts = points(spark, sf_dir)
    cum = with_prefix_sum(dense.assign(pts, first_rows(pts, 3)), "id", "d2")
    total = cum.agg(F.max("cum").alias("total"))
    return cum.join(F.broadcast(total)).filter(F.col("cum") >= F.col("total") * 0.375).agg(F.min("id").alias("id"), F.round(F.max("total"), 6).alias("total"))


@query(f"SELECT CAST(k AS INTEGER) AS k, CAST(pos AS INTEGER) AS pos, round({gaussian(repr('1'), text('k'), text('pos'))}, 6) + 0.0 AS value FROM (SELECT unnest(range(0, 8)) AS k), (SELECT unnest(range(0, 64)) AS pos)")
def gaussian_init(spark, sf_dir):
    return coordinates(spark, lloyd.gaussian(spark, K, 64, seed=1))


@query("SELECT o_orderkey AS id, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS BIGINT) AS batch FROM orders")
def minibatch_index(spark, sf_dir):
    return prepare.batches(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", 1000).select("id", "batch")


@query()
def factorized_kmeans_objective(spark, sf_dir):
    pts = points(spark, sf_dir)
    model = factorized_kmeans(pts, first_rows(pts, 16), n_factors=3, sparsity=4, max_iter=4, palm_iter=20)
    return spark.createDataFrame(list(enumerate(model.trace)), "iter int, objective double").withColumn("n_param", F.lit(model.n_param))


@query()
def factorized_kmeans_minibatch(spark, sf_dir):
    """The batch-wise variant: a job a batch, an empty cluster takes a random member of the largest."""
    pts = points(spark, sf_dir)
    u = first_rows(pts, 16)
    u[5] = u[2]
    return factorized_kmeans(pts, u, n_factors=3, sparsity=4, max_iter=3, palm_iter=20, empty="random", seed=3, batch_size=max(200, pts.count() // 4)).transform(pts)


@query()
def experiment_record(spark, sf_dir):
    from vecloom.experiment import Options, as_frame, run

    options = Options(k=8, init="first", max_iter=3, test=50, nn=True, ami=True, nystrom=100)
    return as_frame(spark, run(points(spark, sf_dir), options).record).drop("seconds")


@query()
def factorized_kmeans_assign(spark, sf_dir):
    pts = points(spark, sf_dir)
    return factorized_kmeans(pts, first_rows(pts, 16), n_factors=3, sparsity=4, max_iter=3, palm_iter=20).transform(pts)


@query()
def factorized_kmeans_wide(spark, sf_dir):
    """More centroids than dimensions, factorised in steps from the right; assigned by the sparse factors."""
    pts = points(spark, sf_dir).withColumn("x", F.slice("x", 1, 16))
    model = factorized_kmeans(pts, first_rows(pts, 64), n_factors=3, sparsity=4, max_iter=2, palm_iter=10, hierarchical_init=True, hierarchical_inside=True)
    return model.transform(pts, factored=True).select("id", "k", rounded("d2"))


@query()
def kmeans_then_factorized(spark, sf_dir):
    pts = points(spark, sf_dir)
    model = lloyd.kmeans(pts, first_rows(pts, 16), max_iter=3)
    return factorized_after_kmeans(model.centroids, n_factors=3, sparsity=4, palm_iter=20).transform(pts)


_EVEN, _ODD = "(SELECT * FROM p WHERE id % 2 = 0)", "(SELECT * FROM p WHERE id % 2 = 1)"
_RUNNING = f"""WITH {POINTS}, {first_centroids(K)}, {assigned('a0', 'c0', _EVEN)}, {averaged('m0', 'a0')},
c1 AS (SELECT c0.k, coalesce(m0.u, c0.u) AS u, coalesce(n, 0) AS n FROM c0 LEFT JOIN m0 ON c0.k = m0.k LEFT JOIN (SELECT k, count(*) AS n FROM a0 GROUP BY k) q ON c0.k = q.k),
{assigned('a1', 'c1', _ODD)}, {averaged('m1', 'a1')},
c2 AS (SELECT c1.k, CASE WHEN m1.u IS NULL THEN c1.u ELSE list_transform(list_zip(c1.u, m1.u), lambda z: (z[1] * c1.n + z[2] * q.n) / (c1.n + q.n)) END AS u
  FROM c1 LEFT JOIN m1 ON c1.k = m1.k LEFT JOIN (SELECT k, count(*) AS n FROM a1 GROUP BY k) q ON c1.k = q.k)
"""


@query(_RUNNING + COORDINATES.format("c2"))
def streaming_running_means(spark, sf_dir):
    """Points as a stream: the even ids arrive first, the odd ones are found by a query that starts again from the checkpoint."""
    pts = points(spark, sf_dir)
    source, checkpoint = new_path(spark, "stream-points"), new_path(spark, "stream-state")
    for r in (0, 1):
        pts.filter(F.col("id") % 2 == r).select("id", "x").write.mode("append").parquet(source)
        state = RunningMeans.start(first_rows(pts, K))
        cluster_stream(spark.readStream.schema("id long, x array<double>").parquet(source), state, checkpoint).awaitTermination()
    return coordinates(spark, state.centroids)


@query(lloyd_sql(K, 1) + "\n" + COORDINATES.format("c1"))
def streaming_one_batch(spark, sf_dir):
    """All points in one micro-batch: the running means are those of one pass."""
    pts = points(spark, sf_dir)
    source = new_path(spark, "stream-points")
    pts.select("id", "x").write.parquet(source)
    state = RunningMeans.start(first_rows(pts, K))
    cluster_stream(spark.readStream.schema("id long, x array<double>").parquet(source), state, new_path(spark, "stream-state")).awaitTermination()
    return coordinates(spark, state.centroids)


@query("SELECT CAST(kk AS INTEGER) AS k, count(*) AS n FROM (SELECT CASE WHEN (l_quantity - 10) ** 2 <= (l_quantity - 40) ** 2 THEN 0 ELSE 1 END AS kk FROM lineitem) GROUP BY kk")
def assign_wide(spark, sf_dir):
    rows = feature_points(load(spark, sf_dir, "lineitem"), "l_orderkey", ["l_quantity"])
    return dense.assign(rows, np.array([[10.0], [40.0]])).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {POINTS}, f AS (SELECT x FROM p ORDER BY {uniform_sql(repr('3'), text('id'))}, id LIMIT 1), d AS (SELECT p.id, {sq('p.x', 'f.x')} AS d2 FROM p, f), c AS (SELECT sum(d2) AS cost FROM d) "
    f"SELECT id, round(d2, 6) AS d2 FROM d, c WHERE {uniform_sql(repr('3'), repr('0'), text('id'))} * cost < d2 * 40"
)
def kmeans_parallel_round(spark, sf_dir):
    """The points that the first round of k-means|| draws: some 40 in proportion to their squared distances."""
    pts = points(spark, sf_dir)
    first = lloyd.first_by_hash(pts, 1, 3)
    placed = dense.assign(pts, first)
    cost = placed.agg(F.sum("d2").alias("cost"))  # one row
    drawn = placed.join(F.broadcast(cost)).filter(lloyd.uniform(3, 0, F.col("id")) * F.col("cost") < F.col("d2") * 40)
    return drawn.select("id", F.round("d2", 6).alias("d2"))


@query()
def kmeans_parallel(spark, sf_dir):
    """Members and cost of the clusters that k-means|| starts with."""
    pts = points(spark, sf_dir)
    placed = dense.assign(pts, lloyd.parallel_plus_plus(pts, K, seed=3))
    return placed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d2"), 4).alias("cost"))


_HOT = """w AS (SELECT field, value, CAST(row_number() OVER (ORDER BY field, value) - 1 AS INTEGER) AS i FROM
 (SELECT DISTINCT 'l_partkey' AS field, CAST(l_partkey AS VARCHAR) AS value FROM lineitem UNION SELECT DISTINCT 'l_shipmode_flag', l_returnflag FROM lineitem)),
h AS (SELECT DISTINCT l_orderkey AS id, w.i FROM lineitem JOIN w ON (field = 'l_partkey' AND value = CAST(l_partkey AS VARCHAR)) OR (field = 'l_shipmode_flag' AND value = l_returnflag))"""
_HOT = _HOT.replace("l_shipmode_flag", "l_returnflag")


def baskets(spark, sf_dir: str):
    """Sparse vectors of orders: the parts and return flags of their lines; and the vocabulary."""
    found = sparse_points.items(load(spark, sf_dir, "lineitem"), "l_orderkey", ["l_partkey", "l_returnflag"])
    words = sparse_points.vocabulary(found)
    return sparse_points.vectors(found, words), words


@query(f"WITH {_HOT} SELECT id, CAST(count(*) AS DOUBLE) AS sq_norm, CAST(min(i) AS INTEGER) AS first, CAST(max(i) AS INTEGER) AS last FROM h GROUP BY id")
def sparse_one_hot(spark, sf_dir):
    rows, _ = baskets(spark, sf_dir)
    return rows.select("id", sparse_points.sq_norm(F.col("values")).alias("sq_norm"), F.array_min("indices").alias("first"), F.array_max("indices").alias("last"))


@query(
    f"WITH {_HOT}, d AS (SELECT count(*) AS d FROM w), n AS (SELECT id, count(*) AS n FROM h GROUP BY id), "
    "dots AS (SELECT h.id, k, sum(CASE WHEN i % 4 = k THEN 0.5 ELSE 0 END) AS dot FROM h, (SELECT unnest(range(0, 4)) AS k) GROUP BY h.id, k), "
    "u AS (SELECT k, (SELECT count(*) FROM w WHERE i % 4 = k) * 0.25 AS norm FROM (SELECT unnest(range(0, 4)) AS k)), "
    "r AS (SELECT dots.id, dots.k, n - 2 * dot + norm AS d2, row_number() OVER (PARTITION BY dots.id ORDER BY n - 2 * dot + norm, dots.k) AS r FROM dots JOIN n ON n.id = dots.id JOIN u ON u.k = dots.k) "
    "SELECT id, CAST(k AS INTEGER) AS k, round(CAST(d2 AS DOUBLE), 6) AS d2 FROM r WHERE r = 1"
)
def sparse_assign(spark, sf_dir):
    """Orders by the nearest of four centroids, each a half at every fourth word of the vocabulary."""
    rows, words = baskets(spark, sf_dir)
    centroids = (np.arange(words.count())[None, :] % 4 == np.arange(4)[:, None]) * 0.5
    return sparse_points.assign(rows, centroids).select("id", "k", F.round("d2", 6).alias("d2"))


@query(f"{lloyd_sql(K, 1)} {COORDINATES.format('c1')}")
def minibatch_by_batches(spark, sf_dir):
    """One epoch over a table partitioned by batch, batches of 120 rows, the last one short."""
    pts = points(spark, sf_dir)
    return coordinates(spark, lloyd.minibatch_kmeans(pts, first_rows(pts, K), max_iter=1, batch_size=max(120, pts.count() // 5 + 20)).centroids)


@query(f"WITH {POINTS} SELECT i AS row, CAST(pos AS INTEGER) AS pos, round(v, 5) + 0.0 AS value FROM (SELECT row_number() OVER (ORDER BY id) - 1 AS i, unnest(x) AS v, unnest(range(0, len(x))) AS pos FROM p)")
def raw_matrix_parts(spark, sf_dir):
    """The vectors written as one raw file of 4-byte floats and read by many tasks."""
    path = new_path(spark, "raw")
    raw.write_raw(points(spark, sf_dir).coalesce(1).sortWithinPartitions("id"), path, 64)
    rows = raw.read_raw(spark, path, 64, part_bytes=1 << 14)
    return rows.select("row", F.posexplode("x").alias("pos", "value")).select("row", "pos", rounded("value", 5))


@query()
def factorized_kmeans_by_chain(spark, sf_dir):
    """Passes that apply the sparse factors one after the other."""
    pts = points(spark, sf_dir)
    return factorized_kmeans(pts, first_rows(pts, 16), n_factors=3, sparsity=4, max_iter=3, palm_iter=20, by_chain=True).transform(pts, factored=True).select("id", "k", F.round("d2", 6).alias("d2"))
