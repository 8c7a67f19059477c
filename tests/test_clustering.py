from __future__ import annotations

import numpy as np
import pytest

from vecloom.operators import dense, lloyd
from vecloom.operators.factorized_kmeans import factorized_after_kmeans, factorized_kmeans
from vecloom.operators.prepare import blobs
from vecloom.sources.tables import points
from vecloom.streaming.running_means import RunningMeans, cluster_stream


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")


def brute(x, u):
    d2 = ((x[:, None, :] - u[None]) ** 2).sum(-1)
    return d2.argmin(axis=1), d2.min(axis=1)


@pytest.fixture(scope="module")
def data():
    return np.random.default_rng(3).normal(size=(300, 5))


def test_assign_equals_brute_force_and_ignores_partitions(spark, data):
    u = data[:7].copy()
    u[5] = u[2]  # equal centroids: the lower one wins
    k, d2 = brute(data, u)
    for n in (1, 5):
        got = {r["id"]: r for r in dense.assign(frame(spark, data).repartition(n), u).collect()}
        assert [got[i]["k"] for i in range(300)] == k.tolist()
        assert np.allclose([got[i]["d2"] for i in range(300)], d2)
    assert 5 not in k
    native = {r["id"]: r["k"] for r in dense.assign_native(frame(spark, data), u).collect()}
    assert [native[i] for i in range(300)] == k.tolist()
    scores = {r["id"]: r["k"] for r in dense.operator_scores(frame(spark, data), u).collect()}
    assert [scores[i] for i in range(300)] == k.tolist()


def test_pass_sums(spark, data):
    u = data[:4]
    k, d2 = brute(data, u)
    got = dense.pass_over(frame(spark, data).repartition(3), u)
    assert got.counts.tolist() == np.bincount(k, minlength=4).tolist()
    assert np.allclose(got.means, [data[k == i].mean(axis=0) for i in range(4)])
    assert np.isclose(got.objective.sum(), d2.sum())


def test_pass_of_many_tasks(spark, data):
    """Partial sums of more tasks than groups are added to K rows."""
    u = data[:4]
    got = dense.pass_over(frame(spark, data).repartition(80), u)
    k, _ = brute(data, u)
    assert np.allclose(got.sums, [data[k == i].sum(axis=0) for i in range(4)]) and got.counts.sum() == 300


def test_several_empty_clusters(spark, data):
    """Each takes from the then largest cluster the point farthest from its own old centroid, no point twice."""
    u = np.vstack([data[:3], data[:1], data[1:2] * 0 + data[0], data[:1]])
    k, _ = brute(data, u)
    members, taken, stolen = [list(np.flatnonzero(k == i)) for i in range(len(u))], set(), {}
    for c in range(len(u)):
        if not members[c]:
            donor = max(range(len(u)), key=lambda i: (len(members[i]), -i))
            far = max((p for p in members[donor] if p not in taken), key=lambda p: (((data[p] - u[c]) ** 2).sum(), -p))
            members[donor].remove(far)
            taken.add(far)
            stolen[c] = [far]
    for c, points in stolen.items():
        members[c] = points
    got, counts = lloyd.repair(frame(spark, data), u, dense.pass_over(frame(spark, data), u), "farthest")
    assert len(stolen) == 3 and counts.tolist() == [len(m) for m in members]
    assert np.allclose(got, [data[m].mean(axis=0) for m in members])
    other, counts = lloyd.repair(frame(spark, data), u, dense.pass_over(frame(spark, data), u), "random", 3)
    assert counts.sum() == 300 and (counts[3:] == 1).all() and len(np.unique(other[3:], axis=0)) == 3


def test_sizes_are_checked(spark, data, monkeypatch):
    monkeypatch.setattr(dense, "MAX_CENTROID_VALUES", 10)
    monkeypatch.setattr(dense, "MAX_LITERAL_VALUES", 10)
    table = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(data[:4])], "k int, u array<double>")
    for made in (dense.assign_native, dense.operator_scores):
        with pytest.raises(ValueError):
            made(frame(spark, data), data[:4])
    with pytest.raises(ValueError):
        dense.distances(frame(spark, data), table)


def test_empty_table(spark):
    got = dense.pass_over(frame(spark, []), np.ones((2, 3)))
    assert got.counts.tolist() == [0, 0] and not got.sums.any()
    assert lloyd.kmeans(frame(spark, []), np.ones((2, 3)), max_iter=2).counts.tolist() == [0, 0]


def test_objectives_of_a_pass(spark, data):
    u = data[:6]
    model = lloyd.kmeans(frame(spark, data), u, max_iter=1)
    k, d2 = brute(data, u)
    assert np.isclose(model.trace[0][0], d2.sum())
    assert np.isclose(model.trace[0][1], ((data - model.centroids[k]) ** 2).sum())


def test_objective_never_rises_and_stops(spark, data):
    model = lloyd.kmeans(frame(spark, data), data[:6], max_iter=60)
    after = [b for _, b in model.trace]
    assert all(a >= b - 1e-9 for a, b in zip(after, after[1:]))
    assert len(model.trace) < 60
    with pytest.raises(ValueError):
        lloyd.kmeans(frame(spark, data), data[:6], max_iter=0)


@pytest.mark.parametrize("empty_at", [1, 3])
def test_repair_keeps_counts_with_their_clusters(spark, empty_at):
    """Sizes 5, 3, 2 and one empty cluster, in the middle or last: weights stay with the cluster's own id."""
    groups = {c: n for c, n in zip([i for i in range(4) if i != empty_at], (5, 3, 2))}
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(scale=0.1, size=(n, 2)) + 20 * c for c, n in groups.items()])
    u = np.array([[20.0 * c] * 2 for c in range(4)])
    u[empty_at] = [1000.0, -1000.0]
    model = lloyd.kmeans(frame(spark, x), u, max_iter=1)
    want = [0] * 4
    for c, n in groups.items():
        want[c] = n
    want[int(np.argmax(want))] -= 1
    want[empty_at] = 1
    assert model.counts.tolist() == want
    donor = x[: groups[min(groups)]]
    stolen = donor[((donor - u[empty_at]) ** 2).sum(axis=1).argmax()]
    assert np.allclose(model.centroids[empty_at], stolen)
    rest = donor[~(donor == stolen).all(axis=1)]
    assert np.allclose(model.centroids[min(groups)], rest.mean(axis=0))  # the stolen point has left its mean


def test_empty_policies(spark, data):
    u = data[:3].copy()
    u[2] = 1e6
    assert not lloyd.kmeans(frame(spark, data), u, max_iter=1, empty="zero").centroids[2].any()
    with pytest.raises(ValueError):
        lloyd.kmeans(frame(spark, data), u, max_iter=1, empty="error")
    with pytest.raises(ValueError):
        lloyd.kmeans(frame(spark, data), u, max_iter=1, empty="other")
    a = lloyd.kmeans(frame(spark, data), u, max_iter=1, empty="random", seed=1)
    b = lloyd.kmeans(frame(spark, data).repartition(3), u, max_iter=1, empty="random", seed=1)
    assert np.allclose(a.centroids, b.centroids) and (data == a.centroids[2]).all(axis=1).any()


def test_l1_projection():
    v = np.array([3.0, -1.0, 0.5])
    got = lloyd.project_l1(v, 2.0)
    assert np.isclose(np.abs(got).sum(), 2.0) and np.allclose(got, [2.0, 0.0, 0.0])
    assert lloyd.project_l1(v, 4.4, slack=0.2) is v  # within radius + slack: as it is
    rng = np.random.default_rng(1)
    for _ in range(50):
        v = rng.normal(size=8)
        p = lloyd.project_l1(v, 1.0)
        assert np.abs(p).sum() <= 1 + 1e-9
        for _ in range(20):  # no other point of the ball is nearer
            q = rng.normal(size=8)
            q /= max(1.0, np.abs(q).sum())
            assert ((v - p) ** 2).sum() <= ((v - q) ** 2).sum() + 1e-9


def test_l1_centroids(spark, data):
    model = lloyd.kmeans(frame(spark, data), data[:4], max_iter=2, l1_radius=0.5)
    assert (np.abs(model.centroids).sum(axis=1) <= 0.5 + 1e-9).all()


def test_initial_centroids(spark, data):
    pts = frame(spark, data)
    first = lloyd.first_by_hash(pts, 5, 3)
    assert np.allclose(first, lloyd.first_by_hash(pts.repartition(4), 5, 3))
    far = lloyd.plus_plus(pts, 5, 3)
    assert len(np.unique(far, axis=0)) == 5
    same = frame(spark, np.ones((4, 2)))
    assert len(lloyd.plus_plus(same, 3)) == 1  # there are no three different points
    assert lloyd.gaussian(spark, 3, 4, 1).shape == (3, 4)


def test_plus_plus_prefers_far_points(spark):
    x = np.concatenate([np.zeros((50, 2)), np.full((1, 2), 100.0)])
    x[:50, 0] = np.linspace(0, 0.01, 50)
    for seed in range(5):
        assert 100.0 in lloyd.plus_plus(frame(spark, x), 2, seed)


def test_running_means_equal_one_pass(spark, data):
    u = data[:3]
    state = RunningMeans.start(u)
    state.update(frame(spark, data), 0)
    assert np.allclose(state.centroids, lloyd.kmeans(frame(spark, data), u, max_iter=1, empty="zero").centroids)
    before = state.centroids.copy()
    state.update(frame(spark, data), 0)  # a replayed batch
    assert np.array_equal(before, state.centroids)
    state.update(frame(spark, np.zeros((0, 5))), 1)
    assert np.array_equal(before, state.centroids)


def test_state_outlives_the_query(spark, data, tmp_path):
    source, checkpoint = f"file://{tmp_path}/points", f"file://{tmp_path}/checkpoint"
    whole = RunningMeans.start(data[:3])
    for i, part in enumerate((data[:100], data[100:250], data[250:])):
        whole.update(frame(spark, part), i)
        frame(spark, part).write.mode("append").parquet(source)
        state = RunningMeans.start(data[:3])
        cluster_stream(spark.readStream.schema("id long, x array<double>").parquet(source), state, checkpoint).awaitTermination()
        assert np.allclose(state.centroids, whole.centroids) and state.counts.tolist() == whole.counts.tolist()
    again = RunningMeans.start(data[:3])
    cluster_stream(spark.readStream.schema("id long, x array<double>").parquet(source), again, checkpoint).awaitTermination()
    assert np.allclose(again.centroids, whole.centroids)


@pytest.mark.parametrize("on_right", [True, False])
def test_more_centroids_than_dimensions(spark, on_right):
    pts = blobs(spark, 300, 16, 64, seed=2)
    u = lloyd.first_by_hash(pts, 64, 1)
    model = factorized_kmeans(pts, u, n_factors=4, sparsity=3, max_iter=2, palm_iter=15, residual_on_right=on_right, hierarchical_init=True, hierarchical_inside=True)
    flat = factorized_kmeans(pts, u, n_factors=4, sparsity=3, max_iter=2, palm_iter=15, residual_on_right=on_right)
    assert model.centroids.shape == (64, 16) and len(model.factors) == 4 and model.n_param < 64 * 16
    assert not np.allclose(model.centroids, flat.centroids)  # the flags make a difference
    assert model.trace[-1] < (16 * 300) * 200
    near = {r["id"]: (r["k"], r["d2"]) for r in model.transform(pts).collect()}
    sparse = {r["id"]: (r["k"], r["d2"]) for r in model.transform(pts, factored=True).collect()}
    assert all(abs(near[i][1] - sparse[i][1]) < 1e-6 * (1 + near[i][1]) for i in near)
    assert all(near[i][0] == sparse[i][0] for i in near)


def test_factorized_kmeans(spark):
    pts = blobs(spark, 200, 16, 9, seed=2)
    u = lloyd.first_by_hash(pts, 9, 1)
    model = factorized_kmeans(pts, u, n_factors=4, sparsity=3, max_iter=5, palm_iter=30)
    assert len(model.factors) == 4 and len(model.trace) <= 5
    assert len(model.factor_traces) == len(model.trace) + 1
    assert model.centroids.shape == (9, 16) and model.counts.sum() == 200
    assert model.transform(pts).count() == 200
    assert model.n_param < 9 * 16 * 4
    assert model.trace[-1] <= model.trace[0]


def test_factorized_kmeans_hierarchical(spark):
    pts = blobs(spark, 120, 8, 4, seed=2)
    u = lloyd.first_by_hash(pts, 4, 1)
    model = factorized_kmeans(pts, u, n_factors=3, sparsity=4, max_iter=2, palm_iter=10, hierarchical_inside=True)
    assert model.centroids.shape == (4, 8)
    after = factorized_after_kmeans(u, n_factors=3, sparsity=8, palm_iter=50)
    assert ((after.centroids - u) ** 2).sum() < (u**2).sum()


def test_kmeans_parallel(spark, sf_dir, monkeypatch):
    """A cost within 1.1 of k-means++'s, over seeds; passes that k doesn't change; copies and fewer points than k."""
    pts = points(spark, sf_dir)
    cost = lambda u: float(lloyd.pass_over(pts, u).objective.sum())
    ours = [cost(lloyd.parallel_plus_plus(pts, 12, seed)) for seed in range(3)]
    theirs = [cost(lloyd.plus_plus(pts, 12, seed)) for seed in range(3)]
    assert np.mean(ours) <= 1.1 * np.mean(theirs)
    passes = []
    monkeypatch.setattr(lloyd, "assign", lambda *a, **o: passes.append(1) or dense.assign(*a, **o))
    for k in (3, 40):
        passes.clear()
        assert len(lloyd.parallel_plus_plus(pts, k, 1, rounds=4)) == k
        assert len(passes) == 5
    few = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(30)], "id long, x array<double>")
    assert sorted(map(tuple, lloyd.parallel_plus_plus(few, 8, 0))) == [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]
    drawn, costs = lloyd.oversampled(pts, lloyd.first_by_hash(pts, 1, 2), 30, 4, 2)
    assert costs == sorted(costs, reverse=True) and len(costs) == 5 and 60 < len(drawn) < 180


def test_weighted_plus_plus():
    """Weights are as good as copies: two heavy places and light noise."""
    x = np.array([[0.0], [10.0], [0.1], [9.9], [5.0]])
    u = lloyd.weighted_plus_plus(x, np.array([100.0, 100.0, 1.0, 1.0, 1e-9]), 2, 0)
    assert sorted(round(v, 3) for v in u[:, 0]) == [0.001, 9.999]


def test_more_centroids_than_a_task_holds(spark, monkeypatch):
    """Block by block: the same assignment, sums, ties and repairs."""
    rng = np.random.default_rng(8)
    x = rng.integers(-3, 4, (120, 3)).astype(float)
    u = np.vstack([x[:9], x[2], np.full((1, 3), 50.0)])
    pts = frame(spark, x)
    keys = list(range(5, 5 + 2 * len(u), 2))
    whole = [dense.pass_over(pts, u), sorted(map(tuple, dense.assign(pts, u, keys).collect())), lloyd.kmeans(pts, u, 2)]
    monkeypatch.setattr(dense, "MAX_CENTROID_VALUES", 7)
    assert dense.blocks_of(u)[:2] == [(0, 2), (2, 4)] and dense.blocks_of(u)[-1] == (10, 11)
    parts = [dense.pass_over(pts, u), sorted(map(tuple, dense.assign(pts, u, keys).collect())), lloyd.kmeans(pts, u, 2)]
    for name in ("counts", "sums", "objective"):
        assert np.allclose(getattr(whole[0], name), getattr(parts[0], name))
    assert whole[1] == parts[1]
    assert np.allclose(whole[2].centroids, parts[2].centroids) and np.allclose(whole[2].trace, parts[2].trace)


def test_factorised_by_chain_and_by_batches(spark):
    """The same model whichever way passes go."""
    rng = np.random.default_rng(4)
    pts = frame(spark, rng.normal(size=(150, 8)))
    u = rng.normal(size=(6, 8))
    plain, chain, parts, both = (
        factorized_kmeans(pts, u, n_factors=2, sparsity=4, max_iter=3, palm_iter=10, **how) for how in ({}, {"by_chain": True}, {"batch_size": 40}, {"by_chain": True, "batch_size": 70})
    )
    for other in (chain, parts, both):
        assert np.allclose(plain.trace, other.trace) and np.allclose(plain.centroids, other.centroids) and np.array_equal(plain.counts, other.counts)
