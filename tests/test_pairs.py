"""Searches and kernels over all pairs: bounded memory and disk, exact results."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom import catalog
from vecloom.operators import dense, kernels, trees
from vecloom.operators import evaluate as ev


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_search_holds_tiles():
    """The scores of 3,000 x 60,000 pairs would be 1,440 MB."""
    rng = np.random.default_rng(0)
    x, u = rng.normal(size=(3000, 4)), rng.normal(size=(60_000, 4))
    assert peak_mb(lambda: dense.nearest(x, u)) < 150


def test_ties_across_tiles(monkeypatch):
    monkeypatch.setattr(dense, "TILE", 7)
    monkeypatch.setattr(dense, "SCORES", 50)
    rng = np.random.default_rng(1)
    x, u = rng.integers(0, 3, (200, 3)).astype(float), rng.integers(0, 3, (90, 3)).astype(float)
    d2 = ((x[:, None] - u[None]) ** 2).sum(axis=2)
    k, near = dense.nearest(x, u)
    assert np.array_equal(k, d2.argmin(axis=1)) and np.array_equal(near, d2.min(axis=1))


def points_of(spark, x, parts=3):
    return spark.createDataFrame([(i, [float(v) for v in row], i % 3) for i, row in enumerate(x)], "id long, x array<double>, label int").repartition(parts)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_kernel_of_all_pairs_shuffles_no_points(spark):
    """The points were copied once a block before they were shuffled."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 3)).astype(np.float32)
    plan = plan_of(kernels.kernel_errors(points_of(spark, x), kernels.Nystrom(x[:4].astype(float), 0.5), rows=20))
    assert "Generate" not in plan and "FlatMapGroups" not in plan and plan.count("CartesianProduct") == 1


def test_kernel_of_several_models(spark):
    """Models of two gammas, single and double floats, copies of a point."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(70, 3)), np.ones((9, 3))])
    models = {"a": kernels.Nystrom(x[:4], 0.5), "b": kernels.Nystrom(x[4:9], 0.5), "c": kernels.Nystrom(x[:1], 0.1)}
    got = kernels.kernel_error_of(points_of(spark, x), models, rows=17)
    for name, model in models.items():
        k, z = np.exp(-model.gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2)), model.embed(x)
        assert np.isclose(got[name], np.linalg.norm(z @ z.T - k) / np.linalg.norm(k), rtol=1e-9)


def sides_of(spark, n=120, d=4, seed=4):
    """Also with copies of a point, of which the lowest id counts."""
    x = np.random.default_rng(seed).normal(size=(n, d))
    x[60:80] = x[50]
    pts = points_of(spark, x)
    d2 = ((x[:40, None] - x[None, 40:]) ** 2).sum(axis=2)
    return pts.filter("id >= 40"), pts.filter("id < 40").select("id", "x"), x, (d2.argmin(axis=1) + 40).tolist()


@pytest.mark.parametrize("shape", ["ball", "box"])
def test_other_cells_are_searched_without_copies_of_points(spark, shape):
    """Test points were copied once a cell that they reach, and both sides once a block of the other."""
    train, test, x, want = sides_of(spark)
    found = ev.one_nn_in_cells(train, test, x[40:46], shape, rows=9)
    plan = plan_of(found)
    assert "CartesianProduct" in plan and "FlatMapCoGroups" not in plan and "Generate" not in plan
    assert [r["train_id"] for r in sorted(found.collect())] == want


def test_tree_whose_top_is_cut_by_joins(spark, monkeypatch):
    """Subtrees of 20 points a task; copies of one point are more than that, and one cut parts them from the others."""
    monkeypatch.setattr(trees, "TASK_VALUES", 80)
    train, test, x, want = sides_of(spark)
    tree = trees.build(train, leaf=6)
    nodes = {r["node"]: r for r in tree.nodes.collect()}
    for n, r in nodes.items():
        if r["at"] is not None:
            assert nodes[2 * n]["n"] + nodes[2 * n + 1]["n"] == r["n"] and nodes[2 * n]["high"][r["at"]] <= r["cut"] < nodes[2 * n + 1]["low"][r["at"]]
    leaves = {r["node"]: r["count"] for r in tree.points.groupBy("node").count().collect()}
    assert leaves == {n: r["n"] for n, r in nodes.items() if r["at"] is None} and sum(leaves.values()) == 80
    assert sorted(n for n in leaves.values() if n > 6) == [21]
    assert [r["train_id"] for r in sorted(trees.one_nn_in_tree(train, test, 6, 9).collect())] == want


def test_tree_search_makes_no_pairs(spark):
    """Every pair of a point and a node that it reaches was a row with the point's vector, written once a level."""
    train, test, _, _ = sides_of(spark)
    plan = plan_of(trees.searches(trees.build(train, leaf=6), test, rows=9)[1])
    assert "CartesianProduct" in plan and "Generate" not in plan


def test_search_over_all_shuffles_no_points(spark, monkeypatch):
    """Both sides were copied once a block of the other and shuffled, or every task held all test points. Ties, and points without a label or a number."""
    monkeypatch.setattr(ev, "MAX_CENTROID_VALUES", 0)
    train, test, x, want = sides_of(spark)
    found = ev.one_nn(train, test)
    assert "CartesianProduct" in plan_of(found) and "FlatMapCoGroups" not in plan_of(found) and "Generate" not in plan_of(found)
    assert [r["train_id"] for r in sorted(found.collect())] == want
    some = train.withColumn("label", F.when(F.col("id") != want[3], F.col("label")))
    odd = spark.createDataFrame([(-1, [float("nan")] * 4)], "id long, x array<double>")
    for rows in (None, 7):
        got = {r["id"]: r for r in ev.one_nn(some, test.unionByName(odd), rows).collect()}
        assert [got[i]["train_id"] for i in range(40)] == want and got[-1]["train_id"] == 40 and np.isnan(got[-1]["d2"])
        assert [got[i]["label"] for i in range(40)] == [None if k == want[3] else k % 3 for k in want]


def test_search_within_what_is_known():
    rng = np.random.default_rng(5)
    x, u = rng.integers(0, 3, (50, 3)).astype(float), rng.integers(0, 3, (20, 3)).astype(float)
    k, d2 = dense.nearest(x, u)
    got = dense.nearest(x, u, d2)
    assert np.array_equal(got[0], k) and np.array_equal(got[1], d2)
    near, at = dense.nearest(x, u, np.where(d2 > 0, d2 - 0.5, d2)), d2 > 0
    assert (near[0][at] == -1).all() and np.array_equal(near[1][at], d2[at] - 0.5) and np.array_equal(near[0][~at], k[~at])
    assert np.array_equal(dense.nearest(x, u, np.full(50, np.inf))[0], k)


@pytest.mark.parametrize("name", ["accuracy", "f1"])
def test_measures_of_a_search_over_all(spark, same_rows, sf_dir, name, monkeypatch):
    """The search below them shuffled copies of both sides, or every task held all test points."""
    monkeypatch.setattr(ev, "MAX_CENTROID_VALUES", 0)
    plan = plan_of(catalog.queries()[name](spark, sf_dir))
    assert "CartesianProduct" in plan and "FlatMapCoGroups" not in plan and "Generate" not in plan
    same_rows(catalog.queries()[name], catalog.oracle_sql()[name])
