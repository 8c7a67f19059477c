"""K-means with given initial centroids, policies for empty clusters and optional L1 projection of centroids.

One distributed job a pass; between passes the driver holds K x d numbers only. The objective of a pass is that
of the centroids used for assignment; ``trace`` has for every pass both this and, once the next pass has run,
the objective of new centroids with old assignments (they differ, and both are in use).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.durable import materialize, new_path, release
from vecloom.functions.vectors import sq_dist
from vecloom.operators.dense import Sums, assign, nearest, pass_over
from vecloom.operators.positions import with_position

POLICIES = ("farthest", "random", "zero", "error")


@dataclass
class KMeansModel:
    centroids: np.ndarray
    counts: np.ndarray
    #: for each pass: objective of the assignment's centroids, and of the updated ones with the same assignment
    trace: list[tuple[float, float]] = field(default_factory=list)

    def transform(self, points: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
        return assign(points, self.centroids, keep=keep)

    def as_rows(self) -> list[tuple[int, int, float]]:
        return [(k, pos, float(v)) for k, row in enumerate(self.centroids) for pos, v in enumerate(row)]


def project_l1(v: np.ndarray, radius: float, slack: float = 0.0) -> np.ndarray:
    """A vector's projection onto the L1 ball; within radius + slack it stays as it is."""
    size = np.abs(v)
    if size.sum() <= radius + slack:
        return v
    down = np.sort(size)[::-1]
    cut = ((np.cumsum(down) - radius) / np.arange(1, len(v) + 1)).max()
    return np.sign(v) * np.maximum(size - max(cut, 0.0), 0.0)


def donors(counts: np.ndarray) -> list[tuple[int, int]]:
    """(empty cluster, donor) in order of ids: the donor is the then largest cluster, the lowest id of ties, with two members or more."""
    counts, out = counts.copy(), []
    for c in np.flatnonzero(counts == 0):
        donor = int(counts.argmax())
        if counts[donor] >= 2:
            counts[donor] -= 1
            counts[c] = 1
            out.append((int(c), donor))
    return out


def _stolen(points: DataFrame, centroids: np.ndarray, wanted: list[tuple[int, int]], policy: str, seed: int) -> dict[int, tuple[int, np.ndarray]]:
    """For each empty cluster the id and vector of the member that it takes, no member twice.

    Two passes whatever the number of empty clusters: the first ranks for each the members of its donor, of which
    as many are kept as clusters take from it; the second fetches the chosen vectors.
    """
    spark = points.sparkSession
    times = Counter(donor for _, donor in wanted)
    rows = [(c, donor, times[donor], [float(v) for v in centroids[c]]) for c, donor in wanted]
    table = F.broadcast(spark.createDataFrame(rows, "c int, donor int, most int, u array<double>"))  # K rows at most
    members = assign(points, centroids, keep=("id", "x")).join(table, F.col("k") == F.col("donor"))
    rank = -sq_dist(F.col("x"), F.col("u")) if policy == "farthest" else -F.xxhash64(F.col("id"), F.lit(seed), F.col("c")).cast("double")
    place = F.row_number().over(Window.partitionBy("c").orderBy("rank", "id"))
    first = members.select("c", "most", "id", rank.alias("rank")).withColumn("place", place).filter(F.col("place") <= len(wanted)).filter(F.col("place") <= F.col("most"))
    order: dict[int, list[int]] = {}
    for r in sorted(first.collect(), key=lambda r: (r["c"], r["place"])):  # K * K ids at most
        order.setdefault(r["c"], []).append(r["id"])
    chosen: dict[int, int] = {}
    for c, _ in wanted:
        chosen[c] = next(i for i in order[c] if i not in chosen.values())
    ids = F.broadcast(spark.createDataFrame([(i,) for i in chosen.values()], "id long"))
    vectors = {r["id"]: np.array(r["x"], np.float64) for r in points.select("id", "x").join(ids, "id").collect()}
    return {c: (i, vectors[i]) for c, i in chosen.items()}


def repair(points: DataFrame, centroids: np.ndarray, got: Sums, policy: str, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Means and counts with empty clusters treated.

    farthest: the empty cluster, in order of ids, takes from the then largest cluster (the lowest id of ties)
    the point farthest from its own old centroid; random: one by the hash of its id. The point leaves the
    donor before means are taken. zero: the centroid becomes the zero vector. error: ValueError.
    """
    counts, sums = got.counts.copy(), got.sums.copy()
    empty = np.flatnonzero(counts == 0)
    if len(empty) and policy == "error":
        raise ValueError(f"empty clusters: {empty.tolist()}")
    wanted = donors(counts) if policy in ("farthest", "random") else []
    if wanted:
        found = _stolen(points, centroids, wanted, policy, seed)
        for c, donor in wanted:
            counts[donor] -= 1
            sums[donor] -= found[c][1]
            counts[c], sums[c] = 1, found[c][1]
    return sums / np.maximum(counts, 1)[:, None], counts


def updated_objective(got: Sums, means: np.ndarray, old: np.ndarray) -> float:
    """Sum of squared distances to ``means`` under the assignment of the pass, from its sums alone.

    sum|x - m|^2 = sum|x - u|^2 + 2 (u - m).(sum x - n u) + n |u - m|^2 for each cluster.
    """
    shift = old - means
    cross = (shift * (got.sums - got.counts[:, None] * old)).sum(axis=1)
    return float((got.objective + 2 * cross + got.counts * (shift**2).sum(axis=1)).sum())


def kmeans(
    points: DataFrame,
    centroids: np.ndarray,
    max_iter: int = 10,
    delta: float = 1e-6,
    empty: str = "farthest",
    l1_radius: float | None = None,
    l1_slack: float = 0.0,
    seed: int = 0,
    passing: Callable[[DataFrame, np.ndarray], Sums] | None = None,
) -> KMeansModel:
    """Passes until the objective changes by a share of at most ``delta``, at least one, at most ``max_iter``."""
    if empty not in POLICIES:
        raise ValueError(f"policy {empty!r}: one of {POLICIES}")
    if max_iter < 1:
        raise ValueError("max_iter is at least 1")
    u = np.array(centroids, np.float64)
    model = KMeansModel(u, np.zeros(len(u), np.int64))
    for _ in range(max_iter):
        got = (passing or pass_over)(points, u)
        new, counts = repair(points, u, got, empty, seed)
        if l1_radius is not None:
            new = np.array([project_l1(row, l1_radius, l1_slack) for row in new])
        model.trace.append((float(got.objective.sum()), updated_objective(got, new, u)))
        model.centroids, model.counts, u = new, counts, new
        if len(model.trace) > 1:
            before, now = model.trace[-2][1], model.trace[-1][1]
            if abs(before - now) <= delta * max(abs(before), 1e-300):
                break
    return model


@dataclass
class Batches:
    """A table of points partitioned by the number of their batch: ``size`` rows each in the order of a key, the last one may be short."""

    table: DataFrame
    size: int
    count: int

    def batch(self, number: int) -> DataFrame:
        """One batch: only its folder is read."""
        return self.table.filter(F.col("batch") == number)


def batched(points: DataFrame, key: str, size: int) -> Batches:
    """Writes (id, x) by batches. One range shuffle numbers the rows; each batch's rows stand in few tasks, so it is few files."""
    if size < 1:
        raise ValueError("a batch has a row at least")
    placed = with_position(points.select(*dict.fromkeys([key, "id", "x"])), key).select("id", "x", F.floor(F.col("pos") / size).alias("batch"))
    path = new_path(points.sparkSession, "batches")
    placed.write.partitionBy("batch").parquet(path)
    table = points.sparkSession.read.schema(placed.schema).parquet(path)
    return Batches(table, size, (table.agg(F.max("batch")).first()[0] or 0) + 1)


def batch_pass(batches: Batches, centroids: np.ndarray, one: Callable[[DataFrame, np.ndarray], Sums] = pass_over) -> Sums:
    """One epoch: a job a batch, the sums merged between them; what ``pass_over`` finds of all points."""
    whole: Sums | None = None
    for number in range(batches.count):
        got = one(batches.batch(number), centroids)
        whole = got if whole is None else Sums(whole.counts + got.counts, whole.sums + got.sums, whole.objective + got.objective)
    return whole


def minibatch_kmeans(points: DataFrame, centroids: np.ndarray, max_iter: int = 10, delta: float = 1e-6, batch_size: int | None = None, key: str = "id", **options) -> KMeansModel:
    """Epochs of batches of ``batch_size`` rows by ``key``, one after the other; empty clusters become zero.

    Batches' sums add up to one pass's, so without a size this is ``kmeans``.
    """
    batches = batched(points, key, batch_size) if batch_size else None
    return kmeans(points, centroids, max_iter, delta, empty="zero", passing=(lambda _, u: batch_pass(batches, u)) if batches else pass_over, **options)


def uniform(*parts: Column | int | str) -> Column:
    """A number strictly between 0 and 1 from the md5 of the parts as text, joined by colons: 52 bits."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def first_by_hash(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """k rows uniformly at random, the same in every run: the first in the order of a hash of seed and id."""
    rows = points.select("id", "x").orderBy(uniform(seed, F.col("id")), "id").limit(k).collect()
    return np.array([r["x"] for r in rows], np.float64)


def plus_plus(points: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """k-means++: each new centroid is drawn with probability in proportion to the squared distance to the others.

    With an exponential variate e from a hash of the id, the row of least e / d2 is such a draw: one aggregate
    a round and no prefix sums.
    """
    chosen = first_by_hash(points, 1, seed)
    while len(chosen) < k:
        drawn = assign(points, chosen, keep=("id", "x")).filter("d2 > 0")
        e = -F.log(uniform(seed, len(chosen), F.col("id")))
        row = drawn.agg(F.min_by("x", F.struct(e / F.col("d2"), F.col("id"))).alias("x")).first()["x"]
        if row is None:
            break
        chosen = np.vstack([chosen, np.array(row, np.float64)])
    return chosen


def weighted_plus_plus(x: np.ndarray, weights: np.ndarray, k: int, seed: int, rounds: int = 20) -> np.ndarray:
    """k centroids of weighted points on the driver: k-means++ draws, then weighted Lloyd passes."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(x), p=weights / weights.sum()))]
    d2 = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(x)) and (weights * d2).sum() > 0:
        chosen.append(int(rng.choice(len(x), p=weights * d2 / (weights * d2).sum())))
        d2 = np.minimum(d2, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    u = x[chosen].copy()
    for _ in range(rounds):
        own, _ = nearest(x, u)
        sums, size = np.zeros_like(u), np.bincount(own, weights, minlength=len(u))
        np.add.at(sums, own, weights[:, None] * x)
        moved = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], u)
        if np.array_equal(moved, u):
            break
        u = moved
    return u


def oversampled(points: DataFrame, first: np.ndarray, draws: int, rounds: int, seed: int) -> tuple[np.ndarray, list[float]]:
    """Points drawn in ``rounds`` rounds, each with probability ``draws * d2 / sum of d2`` by a hash of its id, and the cost before each.

    Each point's squared distance to what is drawn is kept in a table; a round compares points with the last round's draws only.
    About draws * rounds vectors reach the driver: a parameter's size, not the data's.
    """
    chosen, new, costs = first, first, []
    kept = points.select("id", "x").withColumn("least", F.lit(float("inf")))
    for r in range(rounds + 1):
        found = assign(kept, new, keep=("id", "x", "least")).select("id", "x", F.least("least", "d2").alias("least"))
        before, kept = kept, materialize(found, "distances")
        release(before)
        cost = kept.agg(F.sum("least")).first()[0] or 0.0
        costs.append(cost)
        if r == rounds or cost == 0:
            break
        drawn = kept.filter(uniform(seed, r, F.col("id")) * cost < F.col("least") * draws).orderBy("id").select("x").collect()
        if not drawn:
            continue
        new = np.array([row["x"] for row in drawn], np.float64)
        chosen = np.vstack([chosen, new])
    release(kept)
    return chosen, costs


def parallel_plus_plus(points: DataFrame, k: int, seed: int = 0, rounds: int = 5, oversampling: float = 2.0) -> np.ndarray:
    """k-means||: points are drawn ``oversampling * k`` at a time in a fixed number of rounds, and weighted and clustered to k.

    rounds + 2 passes over the points whatever k is, where ``plus_plus`` takes k. Fewer than k centroids come back only
    where fewer different points are drawn.
    """
    drawn, _ = oversampled(points, first_by_hash(points, 1, seed), max(1, round(oversampling * k)), rounds, seed)
    drawn = np.unique(drawn, axis=0)
    return weighted_plus_plus(drawn, pass_over(points, drawn).counts.astype(np.float64), k, seed)


def gaussian_value(*parts: Column | int | str) -> Column:
    """A standard normal number from a hash of the parts."""
    return F.sqrt(F.log(uniform(*parts, 1)) * -2.0) * F.cos(uniform(*parts, 2) * 6.283185307179586)


def gaussian(spark: SparkSession, k: int, d: int, seed: int = 0) -> np.ndarray:
    """k standard normal vectors, each value a function of seed and place."""
    rows = spark.range(k).select(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: gaussian_value(seed, F.col("id"), i)).alias("x"), "id").orderBy("id").collect()
    return np.array([r["x"] for r in rows], np.float64)
