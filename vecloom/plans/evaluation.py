"""Queries of kernels, neighbours and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecloom.durable import new_path
from vecloom.functions.vectors import dot
from vecloom.operators import evaluate as ev
from vecloom.operators import kernels as kn
from vecloom.operators import lloyd, trees
from vecloom.operators.dense import assign
from vecloom.plans.clustering import centroid_table, rounded
from vecloom.plans.registry import POINTS, assigned, first_centroids, query, sq
from vecloom.sources.tables import first_rows, points

K = 8
GAMMA = 0.7


@query(f"WITH {POINTS}, {first_centroids(K)} SELECT p.id, CAST(c0.k AS INTEGER) AS k, round(exp(-0.7 * {sq('p.x', 'c0.u')}), 6) AS v FROM p, c0")
def rbf_kernel(spark, sf_dir):
    pts = points(spark, sf_dir)
    return kn.kernel_table(pts, centroid_table(spark, first_rows(pts, K)), GAMMA).select("id", "k", rounded("v"))


def _gamma(block: int) -> str:
    return f"""WITH {POINTS}, o AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // least({block}, (SELECT count(*) FROM p)) AS b FROM p),
w AS (SELECT * FROM o WHERE b < (SELECT count(*) FROM p) // least({block}, (SELECT count(*) FROM p))),
n AS (SELECT b, avg(list_sum(list_transform(x, lambda v: v * v))) AS norm FROM w GROUP BY b),
m AS (SELECT b, sum(m * m) AS mean FROM (SELECT b, i, avg(v) AS m FROM (SELECT b, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM w) GROUP BY b, i) GROUP BY b)
SELECT round(1 / avg(2 * (norm - mean)), 6) AS gamma FROM n JOIN m ON n.b = m.b"""


@query(_gamma(1000))
def gamma_heuristic(spark, sf_dir):
    return kn.gamma_heuristic(points(spark, sf_dir)).select(rounded("gamma"))


@query(_gamma(150))
def gamma_heuristic_blocks(spark, sf_dir):
    return kn.gamma_heuristic(points(spark, sf_dir), 150).select(rounded("gamma"))


@query()
def nystrom_embedding(spark, sf_dir):
    pts = points(spark, sf_dir)
    z = kn.Nystrom(first_rows(pts, 16), GAMMA).transform(pts)
    return z.select("id", F.posexplode("z").alias("pos", "value")).select("id", "pos", rounded("value", 4))


@query(f"WITH {POINTS}, {first_centroids(16)} SELECT p.id, CAST(c0.k AS INTEGER) AS k, round(exp(-0.7 * {sq('p.x', 'c0.u')}), 5) + 0.0 AS v FROM p, c0")
def nystrom_gram(spark, sf_dir):
    """Products of every point's embedding with the landmarks' embeddings: the kernel itself, wherever one side is a landmark."""
    pts = points(spark, sf_dir)
    u = first_rows(pts, 16)
    model = kn.Nystrom(u, GAMMA)
    held = spark.createDataFrame([(k, [float(v) for v in z]) for k, z in enumerate(model.embed(u))], "k int, u array<double>")
    both = model.transform(pts).join(F.broadcast(held))
    return both.select("id", "k", (F.round(dot(F.col("z"), F.col("u")), 5) + 0.0).alias("v"))


@query()
def nystrom_errors(spark, sf_dir):
    """The reconstruction error of the five landmark families."""
    pts = points(spark, sf_dir)
    model = lloyd.kmeans(pts, first_rows(pts, 16), max_iter=3)
    families = kn.landmark_families(pts, 16, model.centroids, seed=2)
    rows = [(name, kn.reconstruction_error(pts, kn.Nystrom(u, GAMMA), 500)) for name, u in families.items()]
    return spark.createDataFrame(rows, "family string, error double").select("family", rounded("error", 4))


@query(
    f"WITH {POINTS}, l AS (SELECT id, exp(-0.7 * {sq('p.x', '(SELECT x FROM p WHERE id = 0)')}) AS z FROM p), k AS (SELECT a.id, b.id AS other, exp(-0.7 * {sq('a.x', 'b.x')}) AS v FROM p a, p b) "
    "SELECT round(sum((a.z * b.z - k.v) * (a.z * b.z - k.v)), 2) AS gap, round(sum(k.v * k.v), 2) AS exact FROM k JOIN l a ON a.id = k.id JOIN l b ON b.id = k.other"
)
def nystrom_error_one(spark, sf_dir):
    """Squared norms of the error and of the kernel over all pairs of points, with one landmark."""
    pts = points(spark, sf_dir)
    return kn.kernel_errors(pts, kn.Nystrom(first_rows(pts, 1), GAMMA), rows=300).select(rounded("gap", 2), rounded("exact", 2))


@query()
def nystrom_errors_exact(spark, sf_dir):
    """The error of the five landmark families over all pairs of points."""
    pts = points(spark, sf_dir)
    model = lloyd.kmeans(pts, first_rows(pts, 16), max_iter=3)
    families = kn.landmark_families(pts, 16, model.centroids, seed=2)
    rows = list(kn.kernel_error_of(pts, {name: kn.Nystrom(u, GAMMA) for name, u in families.items()}).items())
    return spark.createDataFrame(rows, "family string, error double").select("family", rounded("error", 4))


def halves(spark, sf_dir):
    pts = points(spark, sf_dir)
    return pts.filter("id % 5 <> 0"), pts.filter("id % 5 = 0").select("id", "x")


_NN = f"""{POINTS}, d AS (SELECT s.id, t.id AS train_id, t.label, {sq('s.x', 't.x')} AS d2 FROM p s, p t WHERE s.id % 5 = 0 AND t.id % 5 <> 0),
nn AS (SELECT id, train_id, label, d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, train_id) AS r FROM d) WHERE r = 1)"""


@query(f"WITH {_NN} SELECT id, train_id, CAST(label AS INTEGER) AS label, round(d2, 6) AS d2 FROM nn")
def one_nn_brute(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    return ev.one_nn(train, test).select("id", "train_id", "label", rounded("d2"))


@query(f"WITH {_NN} SELECT id, train_id, CAST(label AS INTEGER) AS label, round(d2, 6) AS d2 FROM nn")
def one_nn_ball(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    return ev.one_nn_in_cells(train, test, first_rows(points(spark, sf_dir), K), "ball").select("id", "train_id", "label", rounded("d2"))


@query(f"WITH {_NN} SELECT id, train_id, CAST(label AS INTEGER) AS label, round(d2, 6) AS d2 FROM nn")
def one_nn_box(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    return ev.one_nn_in_cells(train, test, first_rows(points(spark, sf_dir), K), "box").select("id", "train_id", "label", rounded("d2"))


_PRUNED = f"""{POINTS}, {first_centroids(K)}, {assigned('a', 'c0', '(SELECT * FROM p WHERE id % 5 <> 0)')},
used AS (SELECT k, u FROM c0 WHERE k IN (SELECT k FROM a)), {assigned('b', 'used', '(SELECT * FROM p WHERE id % 5 = 0)')},
d AS (SELECT b.id, a.id AS train_id, {sq('a.x', 'b.x')} AS d2 FROM b JOIN a ON a.k = b.k),
nn AS (SELECT id, train_id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, train_id) AS r FROM d) WHERE r = 1)"""


@query(f"WITH {_PRUNED} SELECT nn.id, train_id, CAST(p.label AS INTEGER) AS label, round(d2, 6) AS d2 FROM nn JOIN p ON p.id = train_id")
def one_nn_pruned(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    return ev.one_nn_pruned(train, test, first_rows(points(spark, sf_dir), K), rows=256).select("id", "train_id", "label", rounded("d2"))


def predicted(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    found = ev.one_nn(train, test).select("id", F.col("label").alias("predicted"))
    return found.join(points(spark, sf_dir).select("id", "label"), "id")


@query(f"WITH {_NN} SELECT round(avg(CASE WHEN nn.label = p.label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM nn JOIN p ON nn.id = p.id")
def accuracy(spark, sf_dir):
    return predicted(spark, sf_dir).agg(F.round(ev.accuracy(F.col("predicted"), F.col("label")), 6).alias("accuracy"))


@query(
    f"WITH {_NN}, s AS (SELECT CAST(sum(CASE WHEN nn.label = 1 AND p.label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS hit, CAST(sum(CASE WHEN p.label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS actual, CAST(sum(CASE WHEN nn.label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS said FROM nn JOIN p ON nn.id = p.id), "
    "r AS (SELECT CASE WHEN said > 0 THEN hit / said ELSE 0 END AS pr, CASE WHEN actual > 0 THEN hit / actual ELSE 0 END AS re FROM s) "
    "SELECT round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN pr * re * 2 / (pr + re) ELSE 0 END, 6) AS f1 FROM r"
)
def f1(spark, sf_dir):
    return ev.f1(predicted(spark, sf_dir), 1).select(rounded("precision"), rounded("recall"), rounded("f1"))


def table(spark, sf_dir):
    pts = points(spark, sf_dir)
    return ev.contingency(assign(pts, first_rows(pts, K), keep=("id", "label")))


_T = f"""{POINTS}, {first_centroids(K)}, {assigned('a', 'c0')},
t AS (SELECT p.label, a.k, count(*) AS n FROM a JOIN p ON a.id = p.id GROUP BY p.label, a.k),
g AS (SELECT *, sum(n) OVER (PARTITION BY label) AS sa, sum(n) OVER (PARTITION BY k) AS sb, sum(n) OVER () AS tt FROM t),
e AS (SELECT (SELECT sum(CAST(n AS DOUBLE) / tt * ln(CAST(n AS DOUBLE) * tt / (CAST(sa AS DOUBLE) * sb))) FROM g) AS mutual,
 (SELECT sum(-(sa / tt) * ln(sa / tt)) FROM (SELECT DISTINCT label, CAST(sa AS DOUBLE) AS sa, tt FROM g)) AS h_label,
 (SELECT sum(-(sb / tt) * ln(sb / tt)) FROM (SELECT DISTINCT k, CAST(sb AS DOUBLE) AS sb, tt FROM g)) AS h_k)"""


@query(f"WITH {_T} SELECT CAST(label AS INTEGER) AS label, CAST(k AS INTEGER) AS k, n FROM t")
def contingency(spark, sf_dir):
    return table(spark, sf_dir)


@query(f"WITH {_T} SELECT round(mutual, 6) AS mutual, round(h_label, 6) AS h_label, round(h_k, 6) AS h_k FROM e")
def mutual_information(spark, sf_dir):
    return ev.entropies(table(spark, sf_dir)).select(rounded("mutual"), rounded("h_label"), rounded("h_k"))


_EMI = """m AS (SELECT CAST(sa AS BIGINT) AS a, CAST(sb AS BIGINT) AS b, CAST(tt AS BIGINT) AS t FROM (SELECT DISTINCT label, sa FROM g), (SELECT DISTINCT k, sb FROM g), (SELECT max(tt) AS tt FROM g)),
x AS (SELECT *, unnest(range(greatest(1, a + b - t), least(a, b) + 1)) AS n FROM m),
i AS (SELECT sum(CAST(n AS DOUBLE) / t * ln(CAST(t AS DOUBLE) * n / (CAST(a AS DOUBLE) * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1)
 - lgamma(t + 1) - lgamma(n + 1) - lgamma(a - n + 1) - lgamma(b - n + 1) - lgamma(t - a - b + n + 1))) AS expected FROM x)"""


@query(f"WITH {_T}, {_EMI} SELECT round(expected, 6) AS expected, round((mutual - expected) / ((h_label + h_k) / 2 - expected), 6) AS ami FROM e, i")
def ami(spark, sf_dir):
    return ev.adjusted_mutual_information(table(spark, sf_dir)).select(rounded("expected"), rounded("ami"))


@query()
def nystrom_svm(spark, sf_dir):
    """Accuracy of a linear machine on the embedding of the first three labels."""
    pts = points(spark, sf_dir).filter("label < 3")
    z = kn.Nystrom(first_rows(pts, 16), GAMMA).transform(pts, keep=("id", "label"))
    found = ev.linear_svm(z.filter("id % 5 <> 0"), z.filter("id % 5 = 0"), max_iter=5)
    return found.agg(F.round(ev.accuracy(F.col("predicted"), F.col("label")), 6).alias("accuracy"))


@query()
def assignment_timing(spark, sf_dir):
    pts = points(spark, sf_dir)
    return ev.timed_assignment(pts, first_rows(pts, 64), 200)


@query(f"WITH {_NN} SELECT id, train_id, CAST(label AS INTEGER) AS label, round(d2, 6) AS d2 FROM nn")
def one_nn_tree(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    return trees.one_nn_in_tree(train, test, leaf=64).select("id", "train_id", "label", rounded("d2"))


@query(
    f"WITH {POINTS}, {first_centroids(K)}, {assigned('a', 'c0')} SELECT count(*) AS n_rows, CAST(sum(len(x)) * 8 AS BIGINT) AS n_bytes, round(sum(d), 4) AS cost, true AS timed FROM a"
)
def observed_assignment(spark, sf_dir):
    """What passes by while an assignment is written: rows, bytes of vectors and cost, without a second pass."""
    pts = points(spark, sf_dir)
    path = new_path(spark, "assigned")
    seen = ev.observed_assignment(pts, first_rows(pts, K), lambda df: df.write.parquet(path))
    rows = [(seen["rows"], seen["bytes"], round(seen["cost"], 4), seen["seconds"] > 0)]
    return spark.createDataFrame(rows, "n_rows long, n_bytes long, cost double, timed boolean")
