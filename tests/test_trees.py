from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import evaluate as ev
from vecloom.operators import trees
from vecloom.sources.tables import first_rows, points


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in row], i % 3) for i, row in enumerate(x)], "id long, x array<double>, label int")


def rows_of(df):
    return sorted((r["id"], r["train_id"], r["label"], round(r["d2"], 9)) for r in df.collect())


def brute(train, test, start):
    d2 = ((test[:, None] - train[None]) ** 2).sum(axis=2)
    own = d2.argmin(axis=1)
    return [(start + i, int(k), int(k) % 3, round(float(d2[i, k]), 9)) for i, k in enumerate(own)]


@pytest.mark.parametrize("leaf,rows", [(5, None), (30, 7), (1000, None)])
def test_exact(spark, leaf, rows):
    """Also with ties, copies, coordinates of one value, and blocks of few rows."""
    rng = np.random.default_rng(1)
    train = np.concatenate([rng.integers(0, 4, (80, 3)), np.full((12, 3), 9)]).astype(float)
    train[:, 2] = 1.0
    test = rng.integers(0, 10, (40, 3)).astype(float)
    got = trees.one_nn_in_tree(frame(spark, train), frame(spark, test, 500), leaf, rows)
    assert rows_of(got) == brute(train, test, 500)


def test_tree(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2)) * [1, 5]
    tree = trees.build(frame(spark, x), leaf=16)
    nodes = {r["node"]: r for r in tree.nodes.collect()}
    assert nodes[1]["n"] == 200 and nodes[1]["at"] == 1 and max(nodes) >= 16
    for n, r in nodes.items():
        if r["at"] is not None:
            assert nodes[2 * n]["n"] + nodes[2 * n + 1]["n"] == r["n"] and nodes[2 * n]["high"][r["at"]] <= r["cut"] < nodes[2 * n + 1]["low"][r["at"]]
    leaves = tree.points.groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["node"]: r["n"] for r in leaves} == {n: r["n"] for n, r in nodes.items() if r["at"] is None}
    assert all(r["n"] <= 16 for r in leaves)


def test_fewer_distances_than_cells(spark, sf_dir):
    """On points of few dimensions most leaves are passed over, and more than cells of one level are."""
    pts = points(spark, sf_dir).select("id", F.slice("x", 1, 3).alias("x"), "label")
    train, test = pts.filter("id % 5 <> 0"), pts.filter("id % 5 = 0").select("id", "x")
    tree = trees.build(train, 16)
    compared = trees.distances_computed(tree, test)
    u = first_rows(pts, 8)
    placed, asked = ev.assign(train, u, keep=("id", "x", "label")), ev.assign(test, u)
    sizes = {r["k"]: r["count"] for r in placed.groupBy("k").count().collect()}
    one_level = sum(sizes.get(r["k"], 0) for r in asked.collect())
    assert compared < one_level < train.count() * test.count()
    assert rows_of(trees.one_nn_in_tree(train, test, 16)) == rows_of(ev.one_nn(train, test))


def test_empty_sides(spark):
    some, none = frame(spark, np.eye(3)), frame(spark, np.eye(3)).filter("false")
    assert trees.one_nn_in_tree(none, some).count() == 0 and trees.one_nn_in_tree(some, none).count() == 0
    assert rows_of(trees.one_nn_in_tree(some.limit(1), frame(spark, np.eye(3), 10))) != []


def slow(spark, seconds):
    def wait(batches):
        for b in batches:
            time.sleep(seconds)
            yield b

    return spark.range(4).mapInArrow(wait, "id long")


def test_limited(spark):
    """A slow action is cancelled and recorded as such; what follows runs, and errors of an action's own are raised."""
    found = ev.limited(spark, 1.0, lambda: slow(spark, 60).count())
    assert found.stopped and found.result is None and found.seconds < 30
    assert ev.limited(spark, 60.0, lambda: slow(spark, 0).count()).result == 4
    with pytest.raises(ZeroDivisionError):
        ev.limited(spark, 60.0, lambda: 1 / 0)
    assert spark.range(10).count() == 10


def test_baseline_record(spark):
    fast, late = lambda: slow(spark, 0), lambda: slow(spark, 60)
    record = ev.baseline_record(spark, fast, late, factor=2.0)
    assert record["stopped"] and record["baseline_s"] is None and record["pruned_s"] > 0
    assert not ev.baseline_record(spark, fast, fast, factor=100.0)["stopped"]


def test_observed(spark):
    x = np.arange(12.0).reshape(6, 2)
    kept = []
    seen = ev.observed_assignment(frame(spark, x), x[:2], lambda df: kept.append(df.collect()))
    assert seen["rows"] == 6 and seen["bytes"] == 96 and np.isclose(seen["cost"], sum(r["d2"] for r in kept[0])) and seen["seconds"] > 0
