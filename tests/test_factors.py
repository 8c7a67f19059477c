from __future__ import annotations

import numpy as np
import pytest

from vecloom.operators import chain as ch
from vecloom.operators import projections as pr
from vecloom.operators.factorize import Const, Ident, TopRowCol, best_scale, budgets, flat_budget, hierarchical, palm, start_factors


@pytest.fixture(scope="module")
def factors():
    rng = np.random.default_rng(5)
    return [rng.integers(0, 3, s).astype(float) for s in ((4, 4), (4, 4), (4, 5))]


def dense_of(rows, shape):
    out = np.zeros(shape)
    for r in rows:
        out[r["i"], r["j"]] = r["v"]
    return out


def test_chain_against_dense(factors):
    c = ch.Chain(factors)
    full = factors[0] @ factors[1] @ factors[2]
    assert np.allclose(c.product(), full) and c.shape == (4, 5) and len(c) == 3
    x = np.random.default_rng(0).normal(size=(5, 3))
    assert np.allclose(c.dot(x), full @ x) and np.allclose(c.dot(x[:, 0]), full @ x[:, 0])
    y = np.random.default_rng(0).normal(size=(4, 3))
    assert np.allclose(c.adjoint().dot(y), full.T @ y)
    assert np.allclose(c.transpose().product(), full.T)
    for n in range(4):
        left = np.linalg.multi_dot([np.eye(4), *factors[:n]]) if n else None
        assert len(c.left(n)) == n and (n == 0 or np.allclose(c.left(n).product(), left))
        assert len(c.right(n)) == n
    assert len(c.left(-1)) == 2 and len(c.right(-1)) == 2
    assert np.allclose(c.right(-1).product(), factors[1] @ factors[2])
    assert np.isclose(c.norm(), np.linalg.norm(full, 2))
    assert ch.Chain([]).shape == (0, 0) and ch.Chain([]).norm() == 1.0
    assert c.non_zeros() == sum(np.count_nonzero(f) for f in factors)
    with pytest.raises(ValueError):
        ch.Chain([factors[0], factors[2], factors[0]])
    with pytest.raises(ValueError):
        c.replaced(1, np.zeros((3, 3)))
    got = c[0]
    got[:] = 9
    assert not (c.factors[0] == 9).all()  # a copy


def test_sparse_storage(spark, factors):
    full = factors[0] @ factors[1] @ factors[2]
    c = ch.Chain(factors).sparse()
    assert all(isinstance(f, ch.Sparse) for f in c.factors) and c.non_zeros() == ch.Chain(factors).non_zeros()
    x = np.random.default_rng(0).normal(size=(5, 3))
    assert np.allclose(c.product(), full) and np.allclose(c.dot(x), full @ x) and np.allclose(c.dot(x[:, 0]), full @ x[:, 0])
    assert np.allclose(c.adjoint().product(), full.T) and np.array_equal(c[1], factors[1]) and c.shape == (4, 5)
    hollow = ch.Sparse((3, 4), np.array([2]), np.array([1]), np.array([5.0]))
    assert np.allclose(hollow.dense() @ np.ones((4, 2)), hollow @ np.ones((4, 2))) and np.allclose(hollow.T.dense(), hollow.dense().T)
    assert not (ch.Sparse.of(np.zeros((2, 3))) @ np.ones(3)).any()
    assert sorted(map(tuple, c.table(spark).collect())) == sorted(map(tuple, ch.Chain(factors).table(spark).collect()))


def test_chain_without_factors(factors):
    c = ch.Chain(factors)
    assert np.array_equal(c.left(0).product(), np.eye(4)) and np.array_equal(c.right(0).product(), np.eye(5))
    assert np.array_equal(ch.Chain([], 3).dot(np.arange(3.0)), np.arange(3.0)) and ch.Chain([], 3).shape == (3, 3)


def test_applications_agree(spark, factors):
    """By held factors and by joins, for a chain with rows that no path reaches and for points that are shorter than it."""
    holes = [f.copy() for f in factors]
    holes[1][2], holes[2][:, 3], holes[0][1] = 0, 0, 0
    table = ch.Chain(holes).table(spark)
    rng = np.random.default_rng(1)
    for d in (5, 4):
        pts = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=d)]) for i in range(30)], "id long, x array<double>")
        want = sorted((r["id"], r["i"], round(r["v"], 9)) for r in ch.apply_by_join(table, 3, pts).collect())
        assert sorted((r["id"], r["i"], round(r["v"], 9)) for r in ch.apply_chain(table, 3, pts).collect()) == want


def test_walsh_hadamard(spark):
    rows = [(n, [float(v) for v in np.random.default_rng(n).normal(size=n)]) for n in (1, 2, 8, 64)]
    got = {}
    for r in ch.hadamard_apply(spark.createDataFrame(rows, "id long, x array<double>")).collect():
        got.setdefault(r["id"], {})[r["i"]] = r["v"]
    for n, x in rows:
        h = 1 - 2 * (np.bitwise_count(np.arange(n)[:, None] & np.arange(n)[None]) % 2).astype(float)
        assert np.allclose([got[n][i] for i in range(n)], h @ x)


def test_chain_tables(spark, factors):
    c = ch.Chain(factors)
    table = c.table(spark)
    assert np.allclose(dense_of(ch.product(table, 3).collect(), (4, 5)), c.product())
    back = ch.transpose(table, 3)
    assert np.allclose(dense_of(ch.product(back, 3).collect(), (5, 4)), c.product().T)
    assert np.allclose(dense_of(ch.product(ch.rightmost(table, 3, 2), 2).collect(), (4, 5)), factors[1] @ factors[2])
    assert np.allclose(dense_of(ch.product(ch.leftmost(table, 3, -1), 2).collect(), (4, 4)), factors[0] @ factors[1])


def test_spectral_norm():
    rng = np.random.default_rng(2)
    for shape in ((5, 9), (9, 5), (1, 4), (6, 6)):
        m = rng.normal(size=shape)
        size, v = ch.spectral_norm(m)
        assert np.isclose(size, np.linalg.norm(m, 2), rtol=1e-4)
        assert np.isclose(ch.spectral_norm(m, v)[0], size, rtol=1e-4)
    assert ch.spectral_norm(np.zeros((3, 3)))[0] == 0.0


def test_hadamard_tables(spark):
    h = dense_of(ch.hadamard(spark, 8).collect(), (8, 8))
    assert np.allclose(h @ h.T, 8 * np.eye(8))
    b = dense_of(ch.butterfly(spark, 8).collect(), (8, 8))
    assert np.allclose(np.linalg.matrix_power(b, 3), h) and (np.count_nonzero(b, axis=1) == 2).all()
    codes = [r["code"] for r in ch.gray_codes(spark, 4).orderBy("i").collect()]
    assert sorted(codes) == list(range(16)) and all(bin(a ^ b).count("1") == 1 for a, b in zip(codes, codes[1:]))


def test_sequency_order_counts_sign_changes(spark):
    eye = spark.createDataFrame([(i, [float(i == j) for j in range(8)]) for i in range(8)], "id long, x array<double>")
    rows = ch.sequency_transform(eye, 3).collect()
    m = np.zeros((8, 8))
    for r in rows:
        m[r["i"], r["id"]] = r["v"] * 8
    assert [int((np.diff(row) != 0).sum()) for row in m] == list(range(8))


M = np.array([[-7, -2, 0, 1], [5, -4, -6, 6], [2, -1, 7, 3], [-5, -8, -3, 4]], float)


def test_projections_keep_the_largest():
    top = pr.keep_top_n(M, 5)
    assert np.count_nonzero(top) == 5
    assert np.abs(top[top != 0]).min() >= np.abs(M[top == 0]).max()
    both = pr.keep_rows_and_columns(M, 8)
    assert (np.count_nonzero(both, axis=0) >= 2).all() and (np.count_nonzero(both, axis=1) >= 2).all()
    assert ((both == M) | (both == 0)).all()


def test_projection_ties_go_to_the_lower_place():
    m = np.ones((3, 3))
    assert np.count_nonzero(pr.keep_top_n(m, 2)[:, 0]) == 2
    kept = pr.keep_rows_and_columns(m, 3)
    assert kept[0].all() and kept[:, 0].all() and not kept[1:, 1:].any()
    assert not pr.keep_rows_and_columns(m, 2).any()  # budgets of 0 a row and column
    assert pr.keep_rows_and_columns(m, 100).all()


def test_projection_tables_equal_arrays(spark):
    table = spark.createDataFrame([(i, j, float(M[i, j])) for i in range(4) for j in range(4)], "i int, j int, v double")
    assert np.allclose(dense_of(pr.top_n(table, 5).collect(), (4, 4)), pr.keep_top_n(M, 5))
    assert np.allclose(dense_of(pr.top_rows_and_columns(table, 4, 4, 8).collect(), (4, 4)), pr.keep_rows_and_columns(M, 8))


def test_palm_lowers_the_objective():
    target = np.random.default_rng(1).normal(size=(16, 24))
    found = palm(target, start_factors(16, 24, 3), flat_budget(16, 24, 3, 6), max_iter=60)
    assert found.trace[-1] < 0.8 * found.trace[0]
    assert np.isclose(found.trace[-1], ((target - found.matrix) ** 2).sum())
    assert all(a >= b - 1e-6 * abs(a) for a, b in zip(found.trace[1:], found.trace[2:]))
    for f in found.factors:
        assert np.isclose(np.linalg.norm(f), 1.0)


def naive_palm(target, factors, constraints, scale, rounds):
    """The same sweeps with full products and full decompositions in every step."""
    factors, trace = [f.copy() for f in factors], []
    product = lambda fs, n: np.linalg.multi_dot([np.eye(n), *fs]) if fs else np.eye(n)
    for _ in range(rounds):
        for j in reversed(range(len(factors))):
            left, right = product(factors[:j], factors[j].shape[0]), product(factors[j + 1 :], factors[j].shape[1])
            step = 1.001 * (scale * np.linalg.norm(left, 2) * np.linalg.norm(right, 2)) ** 2
            if step > 0 and not isinstance(constraints[j], Const):
                gradient = scale * left.T @ (scale * left @ factors[j] @ right - target) @ right.T
                new = constraints[j].project(factors[j] - gradient / step)
                if np.linalg.norm(new):
                    factors[j] = new / np.linalg.norm(new)
        whole = product(factors, target.shape[0])
        scale = (target * whole).sum() / (whole * whole).sum()
        trace.append(((target - scale * whole) ** 2).sum())
    return scale, factors, trace


@pytest.mark.parametrize("constant", [False, True])
def test_palm_against_a_naive_version(constant):
    target = np.random.default_rng(7).normal(size=(8, 12))
    start, rules = start_factors(8, 12, 4, constant), flat_budget(8, 12, 4, 3, constant)
    scale, factors, trace = naive_palm(target, start, rules, 1.0, 6)
    got = palm(target, start, rules, max_iter=6, delta=0.0)
    assert np.allclose(got.trace[1:], trace, rtol=1e-3) and np.isclose(got.scale, scale, rtol=1e-3)
    assert all(np.allclose(a, b, atol=1e-3) for a, b in zip(got.factors, factors))


def test_palm_fixes_constants_and_survives_zero():
    fixed = np.diag(np.arange(1.0, 5.0))
    found = palm(np.random.default_rng(1).normal(size=(4, 6)), [fixed, np.eye(4, 6)], [Const(), Ident()], max_iter=20)
    assert np.array_equal(found.factors[0], fixed)
    zero = palm(np.zeros((4, 4)), start_factors(4, 4, 2), flat_budget(4, 4, 2, 2), max_iter=5)
    assert np.isfinite(zero.matrix).all() and not zero.matrix.any()
    with pytest.raises(ValueError):
        palm(np.eye(2), [np.eye(2)], [])


def test_hierarchical_on_a_sparse_product():
    h = (1 - 2 * (np.bitwise_count(np.arange(16)[:, None] & np.arange(16)[None]) % 2)).astype(float)
    found, traces = hierarchical(h, start_factors(16, 16, 4), budgets(16, 16, 4, 2), max_iter=200)
    assert len(traces) == 3 and len(found.factors) == 4
    assert ((h - found.matrix) ** 2).sum() < 0.9 * (h**2).sum()
    left, traces = hierarchical(h, start_factors(16, 16, 4), budgets(16, 16, 4, 2, residual_on_right=False), residual_on_right=False, max_iter=50)
    assert len(left.factors) == 4 and np.isfinite(left.matrix).all()


def test_scale():
    a = np.random.default_rng(0).normal(size=(123, 234))
    b = np.random.default_rng(1).normal(size=(123, 234))
    assert np.isclose(best_scale(a, b), np.trace(a.T @ b) / np.trace(b.T @ b))
    assert np.isclose(best_scale(a, a), 1.0) and best_scale(a, 0 * a) == 0.0


def test_budgets():
    steps = budgets(10, 32, 4, 2)
    assert [s.split[0] for s in steps] == [TopRowCol(20), TopRowCol(20), TopRowCol(20)]
    assert steps[0].split == [TopRowCol(20), TopRowCol(160)] and steps[1].split[1] == TopRowCol(80)
    assert steps[2].finetune == [TopRowCol(20), TopRowCol(20), TopRowCol(20), TopRowCol(64)]
    const = budgets(10, 32, 4, 2, constant_first=True)
    assert const[0].split == [Const(), Ident()] and const[1].finetune == [Const(), TopRowCol(20), TopRowCol(160)]
    assert const[2].finetune == [Const(), TopRowCol(20), TopRowCol(20), TopRowCol(80)]
    left = budgets(10, 32, 4, 2, residual_on_right=False)
    assert left[0].split == [TopRowCol(50), TopRowCol(64)] and left[2].finetune == [TopRowCol(20), TopRowCol(20), TopRowCol(20), TopRowCol(64)]
    three = budgets(10, 32, 3, 1)
    assert three[1].split == [TopRowCol(10), TopRowCol(80)] and three[1].finetune == [TopRowCol(10), TopRowCol(10), TopRowCol(80)]
    wide = budgets(4, 64, 3, 9)  # the outer factor's budget exceeds the residual's: a second step's refit keeps the residual's
    assert wide[1].split[1] == TopRowCol(576) and wide[1].finetune[2] == TopRowCol(64)
    for n in (3, 4, 5):
        for right in (True, False):
            for k, step in enumerate(budgets(10, 32, n, 2, right, constant_first=True)):
                assert len(step.split) == 2 and len(step.finetune) == k + 2
    assert flat_budget(10, 32, 5, 2, constant_first=True) == [Const(), TopRowCol(20), TopRowCol(20), TopRowCol(20), TopRowCol(64)]


def test_both_ways_to_apply_a_chain_agree(spark, monkeypatch):
    """Long indices, a null coordinate, a row that no path reaches: types and rows are the same."""
    rows = [(0, 0, 1, 2.0), (0, 2, 0, 1.0), (1, 0, 0, 1.0), (1, 1, 2, 3.0), (1, 3, 1, 5.0)]
    table = spark.createDataFrame(rows, "q int, i long, j long, v double")
    points = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [None, 1.0, 1.0]), (3, [0.0, 0.0, 0.0])], "id long, x array<double>")
    shown = lambda df: (df.dtypes, sorted((r["id"], r["i"], "nan" if r["v"] != r["v"] else r["v"]) for r in df.collect()))
    held = shown(ch.apply_chain(table, 2, points))
    monkeypatch.setattr(ch, "MAX_HELD", 0)
    joined = shown(ch.apply_chain(table, 2, points))
    assert held == joined and ("nan" in {v for _, _, v in held[1]}) and len(held[1]) == 6
