"""Queries of factor chains, transforms and projections.

Matrices come from the tables: factors and the matrix to factorise from lineitem, points are the embeddings.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.durable import new_path
from vecloom.functions.vectors import pad_pow2
from vecloom.operators import chain as c
from vecloom.operators import palm_tables
from vecloom.operators import projections as pr
from vecloom.operators.factorize import TopRowCol, budgets, flat_budget, hierarchical, palm, start_factors
from vecloom.plans.clustering import centroid_table, coordinates, rounded
from vecloom.plans.registry import POINTS, gaussian, query, text
from vecloom.sources.tables import first_rows, load, points, read_factors, write_factors

N = 64


def factors(spark, sf_dir: str) -> DataFrame:
    """Three 64 x 64 factors from all of lineitem: sums of quantity less 25 by keys modulo 64, in hundredths; those under 0.05 left out."""
    keys = (F.col("l_linenumber") % 3).cast("int"), (F.col("l_partkey") % N).cast("int"), ((F.floor(F.col("l_partkey") / N) + F.col("l_suppkey")) % N).cast("int")
    rows = load(spark, sf_dir, "lineitem").groupBy(*[k.alias(n) for k, n in zip(keys, "qij")]).agg(F.sum(F.col("l_quantity") - 25).alias("v"))
    return rows.filter(F.abs("v") >= 5).withColumn("v", F.col("v") / 100.0)


_F = f"""{POINTS}, f AS (SELECT * REPLACE (v / 100.0 AS v) FROM (SELECT CAST(l_linenumber % 3 AS INTEGER) AS q, CAST(l_partkey % 64 AS INTEGER) AS i, CAST((l_partkey // 64 + l_suppkey) % 64 AS INTEGER) AS j,
  sum(l_quantity - 25) AS v FROM lineitem GROUP BY 1, 2, 3) WHERE abs(v) >= 5),
m12 AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM f a JOIN f b ON a.j = b.i WHERE a.q = 1 AND b.q = 2 GROUP BY a.i, b.j),
m012 AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM f a JOIN m12 b ON a.j = b.i WHERE a.q = 0 GROUP BY a.i, b.j)"""


@query(f"WITH {_F} SELECT i, j, round(v, 6) + 0.0 AS v FROM m12")
def coo_product2(spark, sf_dir):
    f = factors(spark, sf_dir)
    return c.multiply(c.factor(f, 1), c.factor(f, 2)).select("i", "j", rounded("v"))


@query(f"WITH {_F} SELECT i, j, round(v, 6) + 0.0 AS v FROM m012")
def coo_product3(spark, sf_dir):
    return c.product(factors(spark, sf_dir), 3).select("i", "j", rounded("v"))


@query(f"WITH {_F}, y AS (SELECT id, unnest(x) AS b, unnest(range(0, 64)) AS j FROM p) SELECT y.id, m.i, round(sum(m.v * y.b), 6) + 0.0 AS v FROM m012 m JOIN y ON m.j = y.j GROUP BY y.id, m.i")
def coo_chain_apply(spark, sf_dir):
    pts = points(spark, sf_dir).select("id", "x")
    return c.apply_chain(factors(spark, sf_dir), 3, pts).select("id", "i", rounded("v"))


@query(f"WITH {_F} SELECT CAST(2 - q AS INTEGER) AS q, j AS i, i AS j, round(v, 6) AS v FROM f")
def coo_transpose(spark, sf_dir):
    return c.transpose(factors(spark, sf_dir), 3).select("q", "i", "j", F.round("v", 6).alias("v"))


@query(f"WITH {_F} SELECT 'left' AS side, q, count(*) AS n FROM f WHERE q < 2 GROUP BY q UNION ALL SELECT 'right', CAST(q - 1 AS INTEGER), count(*) FROM f WHERE q >= 1 GROUP BY q UNION ALL SELECT 'all_but_last', q, count(*) FROM f WHERE q < 2 GROUP BY q")
def coo_sub_chains(spark, sf_dir):
    f = factors(spark, sf_dir)
    sides = {"left": c.leftmost(f, 3, 2), "right": c.rightmost(f, 3, 2), "all_but_last": c.leftmost(f, 3, -1)}
    parts = [df.groupBy("q").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "q", "n") for name, df in sides.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    f"WITH {_F}, y AS (SELECT id, unnest(x) AS b, unnest(range(0, 64)) AS i FROM p), s1 AS (SELECT y.id, f.j AS i, sum(f.v * y.b) AS b FROM f JOIN y ON f.i = y.i WHERE q = 0 GROUP BY y.id, f.j), "
    "s2 AS (SELECT s1.id, f.j AS i, sum(f.v * s1.b) AS b FROM f JOIN s1 ON f.i = s1.i WHERE q = 1 GROUP BY s1.id, f.j) SELECT id, i, round(b, 6) + 0.0 AS v FROM s2"
)
def coo_adjoint_apply(spark, sf_dir):
    pts = points(spark, sf_dir).select("id", "x")
    first_two = c.leftmost(factors(spark, sf_dir), 3, 2)
    return c.apply_chain(c.transpose(first_two, 2), 2, pts).select("id", "i", rounded("v"))


@query(f"WITH {_F}, a AS (SELECT i, j, v FROM f WHERE q = 0), g AS (SELECT coalesce(a.v, 0) AS a, coalesce(m.v, 0) AS b FROM a FULL JOIN m12 m ON a.i = m.i AND a.j = m.j) SELECT round(sum((a - b) * (a - b)), 6) AS error, round(sum(a * b) / sum(b * b), 6) AS scale FROM g")
def frobenius_and_scale(spark, sf_dir):
    f = factors(spark, sf_dir)
    return c.difference(c.factor(f, 0), c.multiply(c.factor(f, 1), c.factor(f, 2))).select(rounded("error"), rounded("scale"))


@query(f"WITH {_F} SELECT q, i, j, round(v, 6) + 0.0 AS v, 0.5::DOUBLE AS scale FROM f")
def factors_round_trip(spark, sf_dir):
    path = new_path(spark, "factors")
    write_factors(factors(spark, sf_dir), 0.5, path)
    chain, scale = read_factors(spark, path)
    return chain.select("q", "i", "j", rounded("v"), F.lit(scale).alias("scale"))


@query(f"WITH {_F} SELECT count(*) AS n_param FROM f WHERE v <> 0")
def param_count(spark, sf_dir):
    return c.non_zeros(factors(spark, sf_dir))


@query(
    f"WITH {POINTS} SELECT a.id, CAST(i AS INTEGER) AS i, round(sum(CASE WHEN bit_count(i & j) % 2 = 0 THEN v ELSE -v END), 6) + 0.0 AS v "
    "FROM (SELECT id, unnest(x) AS v, unnest(range(0, len(x))) AS j FROM p) a, (SELECT unnest(range(0, 64)) AS i) GROUP BY a.id, i"
)
def hadamard_apply(spark, sf_dir):
    return c.hadamard_apply(points(spark, sf_dir).select("id", "x")).select("id", "i", rounded("v"))


@query(
    f"WITH {POINTS}, o AS (SELECT i, list_sum(list_transform(range(0, 6), lambda b: ((xor(i, i >> 1) >> b) & 1) << (5 - b))) AS nat FROM (SELECT unnest(range(0, 64)) AS i)) "
    "SELECT a.id, CAST(o.i AS INTEGER) AS i, round(sum(CASE WHEN bit_count(CAST(nat AS BIGINT) & j) % 2 = 0 THEN v ELSE -v END) / 64, 6) + 0.0 AS v "
    "FROM (SELECT id, unnest(x) AS v, unnest(range(0, len(x))) AS j FROM p) a, o GROUP BY a.id, o.i"
)
def sequency_transform(spark, sf_dir):
    return c.sequency_transform(points(spark, sf_dir).select("id", "x"), 6).select(F.col("id"), F.col("i").cast("int").alias("i"), rounded("v"))


@query("SELECT i, xor(i, i >> 1) AS code, lpad(to_base(xor(i, i >> 1), 2), 8, '0') AS bits FROM (SELECT unnest(range(0, 256)) AS i)")
def gray_codes(spark, sf_dir):
    return c.gray_codes(spark, 8)


@query("SELECT i, j, CASE WHEN bit_count(i & j) % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS v FROM (SELECT unnest(range(0, 16)) AS i), (SELECT unnest(range(0, 16)) AS j)")
def hadamard_matrix(spark, sf_dir):
    return c.hadamard(spark, 16)


@query("SELECT i, j, CASE WHEN bit_count(i & j) % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS v FROM (SELECT unnest(range(0, 8)) AS i), (SELECT unnest(range(0, 8)) AS j)")
def hadamard_from_butterflies(spark, sf_dir):
    b = c.butterfly(spark, 8)
    return c.multiply(b, c.multiply(b, b))


@query(
    f"WITH {POINTS} SELECT id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS pos, round(CASE WHEN bit_count(i & j) % 2 = 0 THEN v ELSE -v END, 6) + 0.0 AS v "
    "FROM (SELECT id, unnest(x) AS v, unnest(range(0, 64)) AS j FROM p WHERE id < 3), (SELECT unnest(range(0, 64)) AS i)"
)
def structured_landmarks(spark, sf_dir):
    rows = c.structured_landmarks(points(spark, sf_dir).filter("id < 3").select("id", "x"))
    return rows.select("id", "i", F.posexplode("x").alias("pos", "v")).select("id", "i", "pos", rounded("v"))


@query(
    f"WITH {POINTS}, s AS (SELECT id AS k, x AS u FROM p WHERE id < 3) SELECT a.id, CAST(a.k AS INTEGER) AS k, CAST(i AS INTEGER) AS i, round(sum(CASE WHEN bit_count(i & j) % 2 = 0 THEN v ELSE -v END), 6) + 0.0 AS v "
    "FROM (SELECT p.id, s.k, unnest(list_transform(list_zip(x, u), lambda z: z[1] * z[2])) AS v, unnest(range(0, len(x))) AS j FROM p, s) a, (SELECT unnest(range(0, 64)) AS i) GROUP BY a.id, a.k, i"
)
def structured_operator(spark, sf_dir):
    pts = points(spark, sf_dir)
    return c.structured_apply(pts, centroid_table(spark, first_rows(pts, 3))).select("id", "k", "i", rounded("v"))


_FACTOR = "(SELECT id, id // 96 AS q, id // 3 % 32 AS r, id % 3 AS b FROM (SELECT unnest(range(0, 384)) AS id))"


@query(
    f"SELECT CAST(q AS INTEGER) AS q, CAST((r * 17 + q * 3 + 1) % 32 AS INTEGER) AS i, CAST(((r + b) % 32 * 17 + q * 5 + 2) % 32 AS INTEGER) AS j, round({gaussian(repr('1'), text('id'))}, 6) + 0.0 AS v FROM {_FACTOR}"
)
def random_factors(spark, sf_dir):
    return c.random_factors(spark, 32, 4, 3, seed=1).select("q", "i", "j", rounded("v"))


_COST = "n * (2.0 * (least(k, d) * log2(least(k, d)) + greatest(k, d))) + CAST(least(k, d) AS DOUBLE) * greatest(k, d) + n * d"


@query(f"SELECT CAST(k AS BIGINT) AS k, CAST(n * k * d + n * d AS DOUBLE) AS dense, round(CAST({_COST} AS DOUBLE), 3) AS chain FROM (SELECT 10000 AS n, 64 AS d, unnest(range(8, 2048, 8)) AS k)")
def cost_model(spark, sf_dir):
    grid = spark.range(8, 2048, 8).select(F.col("id").alias("k"), F.lit(10000).alias("n"), F.lit(64).alias("d"))
    dense, sparse = c.cost_model(F.col("n"), F.col("k"), F.col("d"), F.lit(2.0))
    return grid.select("k", dense.alias("dense"), F.round(sparse, 3).alias("chain"))


def supplied(spark, sf_dir: str) -> DataFrame:
    """A matrix from lineitem: part keys modulo 50 by supplier keys modulo 20, sums of quantity less 25."""
    rows = load(spark, sf_dir, "lineitem")
    keys = (F.col("l_partkey") % 50).cast("int").alias("i"), (F.col("l_suppkey") % 20).cast("int").alias("j")
    return rows.groupBy(*keys).agg(F.sum(F.col("l_quantity") - 25).alias("v"))


_M = "m AS (SELECT CAST(l_partkey % 50 AS INTEGER) AS i, CAST(l_suppkey % 20 AS INTEGER) AS j, sum(l_quantity - 25) AS v FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {_M} SELECT i, j, v FROM m ORDER BY abs(v) DESC, j, i LIMIT 25")
def top_n_global(spark, sf_dir):
    return pr.top_n(supplied(spark, sf_dir), 25)


@query(f"WITH {_M} SELECT i, j, v FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY abs(v) DESC, i) AS r FROM m) WHERE r <= 3")
def top_k_per_column(spark, sf_dir):
    return pr.top_k_per_column(supplied(spark, sf_dir), 3)


@query(
    f"WITH {_M} SELECT i, j, v FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY abs(v) DESC, i) AS rc, row_number() OVER (PARTITION BY i ORDER BY abs(v) DESC, j) AS rr FROM m) WHERE rc <= 5 OR rr <= 2"
)
def row_col_union_projection(spark, sf_dir):
    return pr.top_rows_and_columns(supplied(spark, sf_dir), 50, 20, 100)


_BUDGET = """WITH g AS (SELECT unnest([16, 32, 64]) AS k), s AS (SELECT k, step, least(k, 64) AS a FROM g, (SELECT unnest(range(0, 4)) AS step))
SELECT CAST(k AS INTEGER) AS k, CAST(step AS INTEGER) AS step, CAST(CASE WHEN step = 3 THEN greatest(2 * 64, r) ELSE r END AS INTEGER) AS residual
FROM (SELECT *, greatest(2 * a, 64 * a // (2 ** (step + 1))) AS r FROM s)"""


@query(_BUDGET)
def constraint_budget(spark, sf_dir):
    rows = [(k, i, step.split[1].total) for k in (16, 32, 64) for i, step in enumerate(budgets(k, 64, 5, 2))]
    return spark.createDataFrame(rows, "k int, step int, residual int")


def _largest(name: str, matrix: str, by: str, on: str, squarings: int = 10) -> str:
    """CTEs ending in ``name`` (value): the square of the largest singular value of ``matrix``, by powers of its Gram matrix."""
    parts = [f"{name}g AS MATERIALIZED (SELECT a.{by} AS i, b.{by} AS j, sum(a.v * b.v) AS v FROM {matrix} a JOIN {matrix} b ON a.{on} = b.{on} GROUP BY 1, 2)"]
    before = f"{name}g"
    for n in range(squarings):
        over = f"(SELECT sum(v * v) FROM {before})"
        parts.append(f"{name}{n} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) / {over} AS v FROM {before} a JOIN {before} b ON a.j = b.i GROUP BY 1, 2)")
        before = f"{name}{n}"
    parts.append(f"{name} AS MATERIALIZED (SELECT (SELECT sum(g.v * w.v) FROM {name}g g JOIN {before} w ON g.i = w.i AND g.j = w.j) / (SELECT sum(v) FROM {before} WHERE i = j) AS value)")
    return ",\n".join(parts)


@query(f"WITH {_M}, {_largest('s', 'm', 'j', 'i')} SELECT round(sqrt(value), 4) AS norm FROM s")
def spectral_norm_table(spark, sf_dir):
    """The largest singular value of the matrix from lineitem, by power iteration on tables."""
    size, _ = palm_tables.spectral_norm(palm_tables.Matrix(50, 20, supplied(spark, sf_dir)))
    return spark.createDataFrame([(size,)], "norm double").select(rounded("norm", 4))


def _kept(name: str, matrix: str, per_col: int, per_row: int) -> str:
    """CTEs ending in ``name``: the largest of each column and row, over their Frobenius norm."""
    size = "abs(round(v, 10))"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY j ORDER BY {size} DESC, i) AS rc, row_number() OVER (PARTITION BY i ORDER BY {size} DESC, j) AS rr FROM {matrix}"
    return f"{name}k AS MATERIALIZED (SELECT i, j, v FROM ({ranked}) WHERE rc <= {per_col} OR rr <= {per_row}),\n{name} AS MATERIALIZED (SELECT i, j, v / (SELECT sqrt(sum(v * v)) FROM {name}k) AS v FROM {name}k)"


#: From the identity and zero: the right factor is the projection of the first rows; then one step of the left one.
_SWEEP = f"""{_M}, r0 AS (SELECT i, j, v / 1.001 AS v FROM m WHERE i < 20 AND v <> 0), {_kept('r', 'r0', 4, 4)},
{_largest('n', 'r', 'i', 'j')},
gap AS (SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM r UNION ALL SELECT i, j, -v FROM m) GROUP BY i, j),
grad AS (SELECT g.i, r.i AS j, sum(g.v * r.v) AS v FROM gap g JOIN r ON g.j = r.j GROUP BY 1, 2),
l0 AS (SELECT i, j, sum(v) AS v FROM (SELECT i, i AS j, 1.0 AS v FROM (SELECT CAST(unnest(range(0, 20)) AS INTEGER) AS i) UNION ALL SELECT i, j, -v / (1.001 * (SELECT value FROM n)) FROM grad) GROUP BY i, j HAVING sum(v) <> 0),
{_kept('l', 'l0', 10, 4)},
pr AS (SELECT l.i, r.j, sum(l.v * r.v) AS v FROM l JOIN r ON l.j = r.i GROUP BY 1, 2),
fit AS (SELECT (SELECT sum(m.v * pr.v) FROM m JOIN pr ON m.i = pr.i AND m.j = pr.j) / (SELECT sum(v * v) FROM pr) AS scale)"""


@query(f"WITH {_SWEEP} SELECT CAST(q AS INTEGER) AS q, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(v, 5) + 0.0 AS v, round(scale, 2) AS scale FROM (SELECT 0 AS q, * FROM l UNION ALL SELECT 1, * FROM r), fit")
def palm_sweep_tables(spark, sf_dir):
    """One sweep over two factors of the matrix from lineitem, as tables."""
    matrix = palm_tables.Matrix(50, 20, supplied(spark, sf_dir))
    found = palm_tables.palm(matrix, palm_tables.start_factors(spark, 50, 20, 2), [TopRowCol(200), TopRowCol(80)], max_iter=1)
    return found.chain.select("q", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), rounded("v", 5), F.round(F.lit(found.scale), 2).alias("scale"))


def target(spark, sf_dir: str) -> np.ndarray:
    return first_rows(points(spark, sf_dir), 16)[:, :32]


@query()
def palm_trace(spark, sf_dir):
    m = target(spark, sf_dir)
    found = palm(m, start_factors(16, 32, 3), flat_budget(16, 32, 3, 4), max_iter=30)
    return spark.createDataFrame(list(enumerate(found.trace)), "iter int, objective double")


@query()
def hierarchical_palm_product(spark, sf_dir):
    m = target(spark, sf_dir)
    found, _ = hierarchical(m, start_factors(16, 32, 4), budgets(16, 32, 4, 4), max_iter=30)
    return coordinates(spark, found.matrix)


@query(
    f"WITH {POINTS}, m AS (SELECT id AS i, unnest(x[1:32]) AS v, unnest(range(0, 32)) AS j FROM p WHERE id < 16), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY round(abs(v), 10) DESC, i) AS rc, row_number() OVER (PARTITION BY i ORDER BY round(abs(v), 10) DESC, j) AS rr FROM m) "
    "SELECT CAST(i AS INTEGER) AS k, CAST(j AS INTEGER) AS pos, round(CASE WHEN rc <= 2 OR rr <= 4 THEN v ELSE 0 END, 6) + 0.0 AS value FROM r"
)
def palm_projection(spark, sf_dir):
    return coordinates(spark, TopRowCol(64).project(target(spark, sf_dir)))


@query(f"WITH {POINTS} SELECT id, CAST(64 AS INTEGER) AS n, round(list_sum(x[1:37]), 6) + 0.0 AS total FROM p")
def pad_pow2_sizes(spark, sf_dir):
    padded = points(spark, sf_dir).select("id", pad_pow2(F.slice("x", 1, 37)).alias("x"))
    return padded.select("id", F.size("x").alias("n"), (F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 6) + 0.0).alias("total"))
