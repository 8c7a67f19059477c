from __future__ import annotations

from math import comb, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import evaluate as ev
from vecloom.operators import kernels as kn
from vecloom.operators.positions import with_position


def frame(spark, x, y=None):
    y = [0] * len(x) if y is None else y
    return spark.createDataFrame([(i, [float(v) for v in row], int(c)) for i, (row, c) in enumerate(zip(x, y))], "id long, x array<double>, label int")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    return rng.normal(size=(150, 4)), rng.integers(0, 3, 150)


@pytest.mark.parametrize("rows,held", [(7, 0), (1000, 0), (None, 0), (None, 100 * 4), (None, 50 * 4), (None, 8_000_000)])
def test_one_nn_however_the_sides_meet(spark, data, rows, held, monkeypatch):
    """In blocks of any size, with all training points in every task, or with all test points."""
    monkeypatch.setattr(ev, "MAX_CENTROID_VALUES", held)
    x, y = data
    x = x.copy()
    x[60] = x[61]
    pts = frame(spark, x, y)
    train, test = pts.filter("id >= 50"), pts.filter("id < 50")
    got = {r["id"]: r for r in ev.one_nn(train, test, rows).collect()}
    d2 = ((x[:50, None] - x[None, 50:]) ** 2).sum(-1)
    assert [got[i]["train_id"] for i in range(50)] == (d2.argmin(axis=1) + 50).tolist()
    assert [got[i]["label"] for i in range(50)] == y[d2.argmin(axis=1) + 50].tolist()


def test_pruned_search_skips_clusters_without_training_rows(spark, data):
    x, y = data
    pts = frame(spark, x, y)
    u = np.vstack([x[:3], np.full((1, 4), 100.0)])
    far = spark.createDataFrame([(1000, [100.0] * 4)], "id long, x array<double>")
    got = ev.one_nn_pruned(pts, far, u).collect()
    assert len(got) == 1 and got[0]["train_id"] < 150


@pytest.mark.parametrize("shape", ["ball", "box"])
@pytest.mark.parametrize("rows", [None, 11])
def test_cells_skip_only_what_is_farther(spark, data, shape, rows):
    x, y = data
    x = x.copy()
    x[60] = x[61]
    pts = frame(spark, x, y)
    train, test = pts.filter("id >= 50"), pts.filter("id < 50")
    u = np.vstack([x[50:57], np.full((1, 4), 100.0)])
    got = {r["id"]: r["train_id"] for r in ev.one_nn_in_cells(train, test, u, shape, rows).collect()}
    d2 = ((x[:50, None] - x[None, 50:]) ** 2).sum(-1)
    assert [got[i] for i in range(50)] == (d2.argmin(axis=1) + 50).tolist()
    assert ev.one_nn_in_cells(pts.filter("id < 0"), test, u, shape, rows).count() == 0


def test_no_training_rows(spark, data):
    pts = frame(spark, data[0])
    assert ev.one_nn(pts.filter("id < 0"), pts).count() == 0
    assert ev.one_nn(pts, pts.filter("id < 0")).count() == 0


def test_log_factorial(spark):
    n = [0, 1, 2, 5, 10, 100, 12345]
    from math import lgamma

    rows = spark.createDataFrame([(v,) for v in n], "n long").select("n", ev.log_factorial(F.col("n")).alias("l")).collect()
    for r in rows:
        assert abs(r["l"] - lgamma(r["n"] + 1)) <= 1e-11 * max(1.0, lgamma(r["n"] + 1))


def expected_by_hand(a, b, n):
    out = 0.0
    for x in a:
        for y in b:
            for k in range(max(1, x + y - n), min(x, y) + 1):
                out += k / n * log(n * k / (x * y)) * comb(x, k) * comb(n - x, y - k) / comb(n, y)
    return out


def test_adjusted_mutual_information(spark, data):
    rng = np.random.default_rng(7)
    y, k = rng.integers(0, 3, 90), rng.integers(0, 4, 90)
    rows = spark.createDataFrame([(int(a), int(b)) for a, b in zip(y, k)], "label int, k int")
    got = ev.adjusted_mutual_information(ev.contingency(rows)).first()
    a, b = np.bincount(y).tolist(), np.bincount(k).tolist()
    assert np.isclose(got["expected"], expected_by_hand(a, b, 90), atol=1e-10)
    table = np.zeros((3, 4))
    np.add.at(table, (y, k), 1)
    p = table / 90
    mutual = sum(p[i, j] * log(p[i, j] / (p[i].sum() * p[:, j].sum())) for i in range(3) for j in range(4) if p[i, j])
    assert np.isclose(got["mutual"], mutual)
    same = spark.createDataFrame([(int(a), int(a)) for a in y], "label int, k int")
    assert np.isclose(ev.adjusted_mutual_information(ev.contingency(same)).first()["ami"], 1.0)
    single = spark.createDataFrame([(0, 0)] * 5, "label int, k int")
    assert ev.adjusted_mutual_information(ev.contingency(single)).first()["ami"] == 1.0


def test_f1_without_hits(spark):
    rows = spark.createDataFrame([(1, 0), (0, 0)], "label int, predicted int")
    assert ev.f1(rows, 1).first().asDict() == {"precision": 0.0, "recall": 0.0, "f1": 0.0}


def test_rbf_diagonal_and_nystrom_with_all_points(data):
    x = data[0][:40]
    k = kn.rbf_matrix(x, x, 0.5)
    assert np.allclose(np.diag(k), 1.0) and np.allclose(k, np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(-1)))
    z = kn.Nystrom(x, 0.5).embed(x)
    assert np.allclose(z @ z.T, k, atol=1e-6)


def test_nystrom_transform(spark, data):
    model = kn.Nystrom(data[0][:10], 0.5)
    rows = {r["id"]: r["z"] for r in model.transform(frame(spark, data[0])).collect()}
    assert np.allclose([rows[i] for i in range(150)], model.embed(data[0]))


@pytest.mark.parametrize(("n", "block"), [(150, 1000), (150, 150), (150, 60)])
def test_gamma_drops_the_tail(spark, data, n, block):
    x = data[0][:n]
    size = min(block, n)
    means = [((p[:, None] - p[None]) ** 2).sum(-1).mean() for p in (x[at : at + size] for at in range(0, n - size + 1, size))]
    got = kn.gamma_heuristic(frame(spark, x), block).first()["gamma"]
    assert np.isclose(got, 1 / np.mean(means))


def test_structured_landmarks():
    seeds = np.array([[1.0, 2.0, 3.0]])
    got = kn.structured(seeds)
    h = np.array([[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]])
    assert np.array_equal(got, h * np.array([1, 2, 3, 0]))


def test_positions(spark):
    ids = [5, 3, -7, 100, 42, 8]
    rows = with_position(spark.createDataFrame([(i,) for i in ids], "id long"), "id").collect()
    assert {r["id"]: r["pos"] for r in rows} == {v: i for i, v in enumerate(sorted(ids))}
    assert with_position(spark.createDataFrame([], "id long"), "id").count() == 0
