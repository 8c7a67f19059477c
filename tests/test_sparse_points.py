from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import sparse_points as sp


def rows(spark):
    data = [(1, "x", None, "a,b"), (2, "y", "p", " b ,, c"), (3, "x", "p", ""), (4, None, None, None), (5, "10", "x", "a,a")]
    return spark.createDataFrame(data, "key long, one string, two string, list string")


def test_one_hot(spark):
    """A null is no category, equal values of two columns are two words, a row without any has no vector."""
    vectors, words = sp.one_hot(rows(spark), "key", ["one", "two"])
    known = {(r["field"], r["value"]): r["index"] for r in words.collect()}
    assert known == {("one", "10"): 0, ("one", "x"): 1, ("one", "y"): 2, ("two", "p"): 3, ("two", "x"): 4}
    got = {r["id"]: (r["indices"], r["values"]) for r in vectors.collect()}
    assert got == {1: ([1], [1.0]), 2: ([2, 3], [1.0, 1.0]), 3: ([1, 3], [1.0, 1.0]), 5: ([0, 4], [1.0, 1.0])}
    dense = {r["id"]: r["x"] for r in sp.dense(vectors, 5).collect()}
    assert dense[2] == [0.0, 0.0, 1.0, 1.0, 0.0]


def test_listed_items_and_counts(spark):
    found = sp.listed_items(rows(spark), "key", "list")
    words = sp.vocabulary(found)
    got = {r["id"]: (r["indices"], r["values"]) for r in sp.vectors(found, words, counts=True).collect()}
    assert got == {1: ([0, 1], [1.0, 1.0]), 2: ([1, 2], [1.0, 1.0]), 5: ([0], [2.0])}
    # words that a later table has and the vocabulary doesn't are left out
    assert {r["id"]: r["indices"] for r in sp.vectors(found, words.filter("value <> 'b'")).collect()} == {1: [0], 2: [2], 5: [0]}


def test_more_than_a_thousand_values(spark):
    df = spark.range(5000).select("id", F.concat(F.lit("v"), F.col("id") % 3000).alias("c"))
    vectors, words = sp.one_hot(df, "id", ["c"])
    assert words.count() == 3000 and vectors.count() == 5000
    assert vectors.select(F.max(sp.sq_norm(F.col("values")))).first()[0] == 1.0


@pytest.mark.parametrize("cells", [sp.CELLS, 8])
def test_assignment(spark, monkeypatch, cells):
    """Equal to dense vectors' distances, the lowest of ties; also a vector without entries and products in parts."""
    monkeypatch.setattr(sp, "CELLS", cells)
    rng = np.random.default_rng(0)
    x = rng.integers(-2, 3, (300, 12)) * (rng.random((300, 12)) < 0.3)
    x[7] = 0
    u = np.vstack([rng.integers(-1, 2, (4, 12)), np.zeros((2, 12))]).astype(float)
    data = [(i, np.flatnonzero(r).tolist(), r[r != 0].astype(float).tolist()) for i, r in enumerate(x)]
    points = spark.createDataFrame(data, "id long, indices array<int>, values array<double>")
    d2 = ((x[:, None] - u[None]) ** 2).sum(axis=2)
    assigned = sp.assign(points, u)
    got = {r["id"]: (r["k"], round(r["d2"], 9)) for r in assigned.collect()}
    assert got == {i: (int(r.argmin()), float(r.min())) for i, r in enumerate(d2)}
    means = np.zeros_like(u)
    for r in sp.means(points, assigned).collect():
        means[r["k"], r["index"]] = r["value"]
    own = d2.argmin(axis=1)
    for k in set(own.tolist()):
        assert np.allclose(means[k], x[own == k].mean(axis=0))


def test_bounds_and_empty(spark, monkeypatch):
    vectors, words = sp.one_hot(rows(spark).filter("false"), "key", ["one"])
    assert vectors.count() == words.count() == 0 and sp.assign(vectors, np.ones((2, 3))).count() == 0
    monkeypatch.setattr(sp, "MAX_CENTROID_VALUES", 3)
    with pytest.raises(ValueError):
        sp.assign(vectors, np.ones((2, 3)))
