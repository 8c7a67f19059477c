from __future__ import annotations

import numpy as np
import pytest

from vecloom.operators import factorize as fz
from vecloom.operators import palm_tables as pt


def table(spark, m):
    i, j = np.nonzero(m)
    rows = [(int(a), int(b), float(m[a, b])) for a, b in zip(i, j)]
    return pt.Matrix(*m.shape, spark.createDataFrame(rows, "i int, j int, v double"))


def dense(m):
    out = np.zeros((m.rows, m.cols))
    for r in m.table.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def some(rows, cols, seed=0):
    return np.random.default_rng(seed).normal(size=(rows, cols))


@pytest.mark.parametrize("shape", [(9, 5), (4, 11), (1, 6)])
def test_spectral_norm(spark, shape):
    m = some(*shape)
    size, v = pt.spectral_norm(table(spark, m))
    assert np.isclose(size, np.linalg.norm(m, 2), rtol=1e-6)
    again, _ = pt.spectral_norm(table(spark, m * 1.01), v)
    assert np.isclose(again, 1.01 * np.linalg.norm(m, 2), rtol=1e-6)


def test_spectral_norm_of_odd_matrices(spark):
    assert pt.spectral_norm(pt.zeros(spark, 3, 4)) == (0.0, None)
    equal = np.diag([2.0, 2.0, -2.0])
    assert np.isclose(pt.spectral_norm(table(spark, equal))[0], 2.0)
    # without a round that settles, a bound that is not too small
    assert pt.spectral_norm(table(spark, some(6, 6)), rounds=1)[0] >= np.linalg.norm(some(6, 6), 2)


def test_equal_to_the_drivers(spark):
    """Factors, scale and trace of two sweeps over three factors."""
    target = some(8, 6)
    constraints = fz.flat_budget(8, 6, 3, 2)
    want = fz.palm(target, fz.start_factors(8, 6, 3), constraints, max_iter=2)
    got = pt.palm(table(spark, target), pt.start_factors(spark, 8, 6, 3), constraints, max_iter=2)
    assert np.allclose(got.trace, want.trace, rtol=1e-6) and np.isclose(got.scale, want.scale, rtol=1e-6)
    for a, b in zip(got.factors, want.factors):
        assert np.allclose(dense(a), b, atol=1e-6)
    assert got.chain.count() == sum(np.count_nonzero(f) for f in want.factors)


def test_constant_and_free_factors(spark):
    target = some(5, 5, 3)
    start = [some(5, 5, 4), some(5, 5, 5)]
    constraints = [fz.Const(), fz.Ident()]
    want = fz.palm(target, start, constraints, scale=0.7, max_iter=2)
    got = pt.palm(table(spark, target), [table(spark, f) for f in start], constraints, scale=0.7, max_iter=2)
    assert np.allclose(dense(got.factors[0]), start[0]) and np.allclose(dense(got.factors[1]), want.factors[1], atol=1e-6)
    assert np.allclose(got.trace, want.trace, rtol=1e-6)


def test_hierarchical_is_equal_too(spark):
    target = some(6, 5, 7)
    steps = fz.budgets(6, 5, 3, 2)
    want, traces = fz.hierarchical(target, fz.start_factors(6, 5, 3), steps, max_iter=1)
    got, ours = pt.hierarchical(table(spark, target), pt.start_factors(spark, 6, 5, 3), steps, max_iter=1)
    assert np.isclose(got.scale, want.scale, rtol=1e-6)
    assert all(np.allclose(a, b, rtol=1e-6) for x, y in zip(ours, traces) for a, b in zip(x, y))
    for a, b in zip(got.factors, want.factors):
        assert np.allclose(dense(a), b, atol=1e-6)


def test_wrong_sizes(spark):
    with pytest.raises(ValueError):
        pt.palm(table(spark, some(3, 3)), [pt.identity(spark, 3, 2), pt.identity(spark, 3, 3)], [fz.Ident(), fz.Ident()])
    with pytest.raises(ValueError):
        pt.palm(table(spark, some(3, 3)), [pt.identity(spark, 3, 3)], [])
