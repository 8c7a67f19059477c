"""Nearest neighbours, classification and clustering measures."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.durable import materialize
from vecloom.operators.blocks import numbers, packed, pairs, vectors
from vecloom.operators.dense import MAX_CENTROID_VALUES, TILE, assign, matrix, nearest
from vecloom.shipping import ship

#: Rows of either side that meet in one task: as many as have so many values, within bounds.
BLOCK_VALUES, BLOCK_ROWS = 4_000_000, (1024, 1 << 16)


def nearest_in_group(train: DataFrame, test: DataFrame, group: str, rows: int | None = None) -> DataFrame:
    """(id, train_id, label, d2): the nearest training point in the test point's group, the lowest id of ties.

    If one side is few numbers, by its count, it goes to every task and the other side stays where it is. Else, or
    with ``rows``, both sides of a group are dealt to blocks of about so many rows; every pair of blocks is one Arrow
    task, so a group of any size is spread over many. No pair of points becomes a row. Groups without training rows
    give no result.
    """
    ship(train.sparkSession)
    if rows is None:
        widest = train.agg(F.max(F.size("x")).alias("d")).first()["d"] or 1
        if train.count() * widest <= MAX_CENTROID_VALUES:
            return _with_held_train(train, test, group)
        if test.count() * widest <= MAX_CENTROID_VALUES:
            return best_of(_with_held_test(train, test, group))
        rows = min(max(BLOCK_VALUES // widest, BLOCK_ROWS[0]), BLOCK_ROWS[1])
    return best_of(_in_blocks(train, test, group, rows))


def best_of(found: DataFrame) -> DataFrame:
    best = found.groupBy("id").agg(F.min(F.struct("d2", "train_id", "label")).alias("best"))
    return best.select("id", "best.train_id", "best.label", "best.d2")


def _with_held_train(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    """All training points are in every task: bounded by the caller."""
    known = train.select(group, "id", "x", "label").toArrow().sort_by("id")
    place = known.column(group).to_numpy()
    held = train.sparkSession.sparkContext.broadcast({g: (known.column("id").to_numpy()[place == g], matrix(known.column("x").filter(pa.array(place == g))), known.column("label").to_numpy()[place == g]) for g in np.unique(place)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(group).to_numpy(zero_copy_only=False)
            for g in np.unique(asked):
                if g in held.value:
                    ids, x, labels = held.value[g]
                    some = batch.filter(pa.array(asked == g))
                    own, d2 = nearest(matrix(some.column("x")), x)
                    yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(ids[own]), pa.array(labels[own].astype(np.int32)), pa.array(d2)], names=["id", "train_id", "label", "d2"])

    return test.select(group, "id", "x").mapInArrow(run, "id long, train_id long, label int, d2 double")


def _with_held_test(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    """All test points are in every task, which gives each the best of its own training points."""
    asked = test.select(group, "id", "x").toArrow()
    held = train.sparkSession.sparkContext.broadcast((asked.column(group).to_numpy(), asked.column("id").to_numpy(), matrix(asked.column("x")) if asked.num_rows else np.zeros((0, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, ids, x = held.value
        best, own, label = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int32)
        for batch in batches:
            known = pa.table(batch).sort_by("id")
            place = known.column(group).to_numpy()
            for g in np.intersect1d(place, groups):
                some, at = known.filter(pa.array(place == g)), np.flatnonzero(groups == g)
                k, d2 = nearest(x[at], matrix(some.column("x")))
                found = some.column("id").to_numpy()[k]
                better = (d2 < best[at]) | ((d2 == best[at]) & (found < own[at]))
                at, k = at[better], k[better]
                best[at], own[at], label[at] = d2[better], found[better], some.column("label").to_numpy()[k]
        some = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(own[some]), pa.array(label[some]), pa.array(best[some])], names=["id", "train_id", "label", "d2"])

    return train.select(group, "id", "x", "label").mapInArrow(run, "id long, train_id long, label int, d2 double")


def _in_blocks(train: DataFrame, test: DataFrame, group: str, rows: int) -> DataFrame:
    """The best of every block of training points for the test points that meet it."""
    blocks = lambda df, name: df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))
    # one row a group
    sizes = blocks(train, "n_train").join(blocks(test, "n_test"), group)
    sizes = materialize(sizes, "group-sizes")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = train.join(sizes, group).select(group, deal("n_train").alias("a"), every("n_test").alias("b"), "id", "x", "label")
    # the sides may be parts of one table: renamed columns tell them apart
    right = test.select(F.col(group), F.col("id").alias("test_id"), F.col("x").alias("test_x")).join(sizes, group)
    right = right.select(F.col(group).alias("g"), every("n_train").alias("s"), F.pmod(F.xxhash64("test_id"), F.col("n_test")).cast("int").alias("t"), "test_id", "test_x")

    def run(known: pa.Table, asked: pa.Table) -> pa.Table:
        empty = known.num_rows == 0 or asked.num_rows == 0
        known = known.sort_by("id")
        if empty:
            own, d2 = np.zeros(0, np.int64), np.zeros(0)
            asked = asked.slice(0, 0)
        else:
            own, d2 = nearest(matrix(asked.column("test_x")), matrix(known.column("x")))
        return pa.table({"id": asked.column("test_id"), "train_id": known.column("id").take(pa.array(own)), "label": known.column("label").take(pa.array(own)), "d2": d2})

    return left.groupBy(group, "a", "b").cogroup(right.groupBy("g", "s", "t")).applyInArrow(run, "id long, train_id long, label int, d2 double")


#: Values of test points that every task of a search over all holds at most: each task gives a row for every one of them.
MAX_TEST_VALUES = 1_000_000


def one_nn(train: DataFrame, test: DataFrame, rows: int | None = None) -> DataFrame:
    """The nearest of all training points, exactly: every pair of blocks is compared.

    If one side is few numbers, by its count, it goes to every task. Else, or with ``rows``, blocks of both sides meet where
    they are packed: neither points nor copies of them are shuffled, and a task holds two blocks.
    """
    ship(train.sparkSession)
    if rows is None:
        widest = train.agg(F.max(F.size("x")).alias("d")).first()["d"] or 1
        sides = [side.withColumn("all", F.lit(0)) for side in (train, test)]
        if train.count() * widest <= MAX_CENTROID_VALUES:
            return _with_held_train(*sides, "all")
        if test.count() * widest <= min(MAX_TEST_VALUES, MAX_CENTROID_VALUES):
            return best_of(_with_held_test(*sides, "all"))
    return best_of(_in_packed_blocks(train, test, min(rows or TILE, TILE)))


def _in_packed_blocks(train: DataFrame, test: DataFrame, rows: int) -> DataFrame:
    """The best of every partition of training blocks for the test points that meet it."""
    left = packed(test, rows, ("id",), tag="asked-blocks")
    # labels as doubles: one that is null is not a number there
    right = packed(train.withColumn("label", F.col("label").cast("double")), rows, ("id", "label"), ("id",), "train-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None

        def found() -> pa.RecordBatch:
            none = np.isnan(labels)
            columns = [pa.array(ids), pa.array(own), pa.array(np.where(none, 0, labels).astype(np.int32), mask=none), pa.array(np.where(odd, np.nan, d2))]
            return pa.RecordBatch.from_arrays(columns, names=["id", "train_id", "label", "d2"])

        for batch in batches:
            for r in range(batch.num_rows):
                if batch.column("a_block")[r].as_py() != last:
                    if last is not None:
                        yield found()
                    last, x, ids = batch.column("a_block")[r].as_py(), vectors(batch, r, "a_"), numbers(batch, r, "a_id")
                    own, labels, d2, odd = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x)), np.full(len(x), np.inf), np.zeros(len(x), bool)
                known, label = numbers(batch, r, "b_id"), numbers(batch, r, "b_label", np.float64)
                k, got = nearest(x, vectors(batch, r, "b_"), d2)
                # what is not a number counts as farthest
                nan = np.isnan(got)
                got = np.where(nan, np.inf, got)
                better = (k >= 0) & ((got < d2) | ((got == d2) & (known[k] < own)))
                own[better], labels[better], d2[better], odd[better] = known[k[better]], label[k[better]], got[better], nan[better]
        if last is not None:
            yield found()

    return pairs(left, right).mapInArrow(run, "id long, train_id long, label int, d2 double")


def one_nn_pruned(train: DataFrame, test: DataFrame, centroids: np.ndarray, rows: int | None = None) -> DataFrame:
    """The nearest training point of the test point's nearest cluster that has any."""
    placed = assign(train, centroids, keep=("id", "x", "label")).drop("d2")
    used = sorted(r["k"] for r in placed.select("k").distinct().collect())  # at most K rows
    asked = assign(test, np.asarray(centroids)[used], keys=used, keep=("id", "x")).drop("d2")
    return nearest_in_group(placed, asked, "k", rows)


def _cells(placed: DataFrame, centroids: np.ndarray, shape: str) -> tuple[np.ndarray, np.ndarray]:
    """For each cluster the radius of its ball (and nothing), or the low and high corners of its box; NaN for an empty one."""
    n, d = centroids.shape
    if shape == "ball":
        radius = np.full((n, 1), np.nan)
        for r in placed.groupBy("k").agg(F.max("d2").alias("d2")).collect():  # at most K rows
            radius[r["k"]] = np.sqrt(r["d2"])
        return radius, radius
    corners = placed.select("k", F.posexplode("x").alias("pos", "v")).groupBy("k", "pos").agg(F.min("v").alias("low"), F.max("v").alias("high")).toArrow()  # at most K x d rows
    low, high = np.full((n, d), np.nan), np.full((n, d), np.nan)
    k, pos = corners.column("k").to_numpy(), corners.column("pos").to_numpy()
    low[k, pos], high[k, pos] = corners.column("low").to_numpy(), corners.column("high").to_numpy()
    return low, high


def one_nn_in_cells(train: DataFrame, test: DataFrame, centroids: np.ndarray, shape: str = "ball", rows: int | None = None) -> DataFrame:
    """The nearest of all training points, exactly, by bounds as a ball tree ("ball") or a k-d tree ("box") has them.

    The nearest point of the test point's own cluster bounds the distance; of the other clusters only those are
    searched whose ball or box comes as near as that.
    """
    centroids = np.asarray(centroids, np.float64)
    placed = assign(train, centroids, keep=("id", "x", "label"))
    bounds = _cells(placed, centroids, shape)
    placed = placed.drop("d2")
    used = np.flatnonzero(~np.isnan(bounds[0][:, 0]))
    if not len(used):
        return nearest_in_group(placed, test.withColumn("k", F.lit(0)), "k", rows)
    asked = materialize(assign(test, centroids[used], keys=used.tolist(), keep=("id", "x")).drop("d2"), "asked")
    first = materialize(nearest_in_group(placed, asked, "k", rows), "first-neighbours")
    bounded = asked.join(first.select("id", F.col("d2").alias("best")), "id", "left").select("id", "x", F.col("k").alias("own"), F.coalesce("best", F.lit(float("inf"))).alias("best"))
    balls = (centroids, bounds[0]) if shape == "ball" else None
    return best_of(first.unionByName(search_within(bounded, placed.withColumnRenamed("k", "node"), rows, balls).drop("compared")))


#: Points of a block at most where blocks of both sides meet.
MEETING_ROWS = 1024


def _gap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The squared distance of points to the box of y."""
    outside = np.maximum(np.maximum(y.min(axis=0) - x, x - y.max(axis=0)), 0)
    return np.einsum("ij,ij->i", outside, outside)


def search_within(asked: DataFrame, train: DataFrame, rows: int | None = None, balls: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(id, train_id, label, d2, compared): for points (id, x, own, best) what is nearest in the nodes but their own that come within ``best``.

    Blocks of both sides meet by a cartesian product. A task passes over the blocks, and the nodes in a block, whose box, or ball
    of (centers, radii) by node, is farther from a point than the best so far, which falls as it goes; it keeps one row a
    point. Neither the points nor their pairs are shuffled.
    """
    size = min(rows or MEETING_ROWS, MEETING_ROWS)
    left = packed(asked, size, ("id", "own", "best"), ("own",), "asked-blocks")
    right = packed(train, size, ("id", "label", "node"), ("node", "id"), "train-blocks")
    held = train.sparkSession.sparkContext.broadcast(balls)
    reaches = lambda gap, best: gap <= best * (1 + 1e-9) + 1e-12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None

        def found() -> pa.RecordBatch:
            some = compared > 0
            columns = [pa.array(v[some]) for v in (ids, own_best, labels.astype(np.int32), d2, compared)]
            return pa.RecordBatch.from_arrays(columns, names=["id", "train_id", "label", "d2", "compared"])

        for batch in batches:
            for r in range(batch.num_rows):
                if batch.column("a_block")[r].as_py() != last:
                    if last is not None:
                        yield found()
                    last, x = batch.column("a_block")[r].as_py(), vectors(batch, r, "a_")
                    ids, own, best = numbers(batch, r, "a_id"), numbers(batch, r, "a_own"), numbers(batch, r, "a_best", np.float64).copy()
                    own_best, labels, compared, d2 = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.full(len(x), np.inf)
                    if held.value is not None:
                        centers, radii = held.value
                        to_balls = np.stack([np.maximum(np.sqrt(((x - u) ** 2).sum(axis=1)) - radius, 0) ** 2 for u, radius in zip(centers, radii.ravel())], axis=1)
                y = vectors(batch, r, "b_")
                near = np.flatnonzero(reaches(_gap(x, y), best))
                if not len(near):
                    continue
                known, label, node = numbers(batch, r, "b_id"), numbers(batch, r, "b_label"), numbers(batch, r, "b_node")
                starts = np.flatnonzero(np.diff(node, prepend=node[0] - 1))
                for s, e in zip(starts, [*starts[1:], len(node)]):
                    at = near[own[near] != node[s]]
                    at = at[reaches(to_balls[at, node[s]] if held.value is not None else _gap(x[at], y[s:e]), best[at])]
                    if not len(at):
                        continue
                    k, got = nearest(x[at], y[s:e])
                    compared[at] += e - s
                    better = (got < d2[at]) | ((got == d2[at]) & (known[s:e][k] < own_best[at]))
                    at, k = at[better], k[better] + s
                    d2[at], own_best[at], labels[at] = got[better], known[k], label[k]
                    best[at] = np.minimum(best[at], d2[at])
        if last is not None:
            yield found()

    return pairs(left, right).mapInArrow(run, "id long, train_id long, label int, d2 double, compared long")


def accuracy(predicted: Column, actual: Column) -> Column:
    return F.avg(F.when(predicted == actual, 1.0).otherwise(0.0))


def f1(predicted: DataFrame, positive: int) -> DataFrame:
    """precision, recall, f1 of one class from (label, predicted)."""
    hit = F.sum(F.when((F.col("label") == positive) & (F.col("predicted") == positive), 1.0).otherwise(0.0))
    actual = F.sum(F.when(F.col("label") == positive, 1.0).otherwise(0.0))
    said = F.sum(F.when(F.col("predicted") == positive, 1.0).otherwise(0.0))
    sums = predicted.agg(hit.alias("hit"), actual.alias("actual"), said.alias("said"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = sums.select(share("hit", "said").alias("precision"), share("hit", "actual").alias("recall"))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, F.col("precision") * F.col("recall") * 2 / both).otherwise(0.0))


def contingency(labelled: DataFrame) -> DataFrame:
    """(label, k, n) from rows (label, k)."""
    return labelled.groupBy("label", "k").agg(F.count(F.lit(1)).alias("n"))


def _with_margins(table: DataFrame) -> DataFrame:
    """(label, k, n, a, b, total): margins of a contingency table, which has classes x clusters rows."""
    everything = Window.partitionBy(F.lit(0))
    return table.withColumns({"a": F.sum("n").over(Window.partitionBy("label")), "b": F.sum("n").over(Window.partitionBy("k")), "total": F.sum("n").over(everything)})


def log_gamma(z: Column) -> Column:
    """ln Gamma for z >= 1: Stirling's series at z + 8, carried back by the recurrence; exact to about 1e-12."""
    w = z + 8.0
    series = (w - 0.5) * F.log(w) - w + 0.9189385332046727 + (1.0 / 12 - (1.0 / 360 - (1.0 / 1260 - (1.0 / 1680) / (w * w)) / (w * w)) / (w * w)) / w
    shifted = z
    for i in range(1, 8):
        shifted = shifted * (z + float(i))
    return series - F.log(shifted)


def log_factorial(n: Column) -> Column:
    return log_gamma(n.cast("double") + 1.0)


def entropies(table: DataFrame) -> DataFrame:
    """One row: mutual information and both entropies (natural logarithms) of a contingency table."""
    cells = _with_margins(table)
    share = F.col("n") / F.col("total")
    mutual = cells.agg(F.sum(share * F.log(F.col("n").cast("double") * F.col("total") / (F.col("a").cast("double") * F.col("b")))).alias("mutual"))

    def entropy(key: str, size: str, name: str) -> DataFrame:
        sides = cells.groupBy(key).agg(F.max(size).alias("s"), F.max("total").alias("total"))
        p = F.col("s") / F.col("total")
        return sides.agg(F.sum(-p * F.log(p)).alias(name))

    return mutual.join(F.broadcast(entropy("label", "a", "h_label"))).join(F.broadcast(entropy("k", "b", "h_k")))


def expected_mutual(table: DataFrame, spread: float = 60.0) -> DataFrame:
    """One row: the mutual information expected of random tables with the same margins.

    For each pair of margins, terms within ``spread`` standard deviations of the hypergeometric mean are
    summed; those beyond are below the smallest double, so their number grows with the root of the rows only.
    """
    cells = _with_margins(table)
    sides_a = cells.groupBy("label").agg(F.max("a").alias("a"), F.max("total").alias("t"))
    sides_b = cells.groupBy("k").agg(F.max("b").alias("b"))
    pairs = sides_a.join(F.broadcast(sides_b))
    a, b, t = F.col("a").cast("double"), F.col("b").cast("double"), F.col("t").cast("double")
    reach = F.sqrt(a * b / t) * spread + spread
    low = F.greatest(F.lit(1.0), a + b - t, F.floor(a * b / t - reach)).cast("long")
    high = F.least(a, b, F.ceil(a * b / t + reach)).cast("long")
    terms = pairs.select("a", "b", "t", F.explode(F.sequence(low, F.greatest(low, high))).alias("n")).filter(F.col("n") <= F.least("a", "b"))
    n = F.col("n").cast("double")
    weight = log_factorial(a) + log_factorial(b) + log_factorial(t - a) + log_factorial(t - b)
    weight = weight - log_factorial(t) - log_factorial(n) - log_factorial(a - n) - log_factorial(b - n) - log_factorial(t - a - b + n)
    return terms.agg(F.sum(n / t * F.log(t * n / (a * b)) * F.exp(weight)).alias("expected"))


def adjusted_mutual_information(table: DataFrame) -> DataFrame:
    """One row: ami = (mutual - expected) / (mean entropy - expected); 1 if both sides have a single group."""
    row = entropies(table).join(F.broadcast(expected_mutual(table)))
    gap = (F.col("h_label") + F.col("h_k")) / 2 - F.col("expected")
    return row.withColumn("ami", F.when(F.abs(gap) < 1e-12, F.lit(1.0)).otherwise((F.col("mutual") - F.col("expected")) / gap))


def linear_svm(train: DataFrame, test: DataFrame, max_iter: int = 20) -> DataFrame:
    """(label, predicted) of test rows by one-against-all linear machines with classes of equal weight."""
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.functions import array_to_vector

    sizes = train.groupBy("label").count()
    n, classes = sizes.agg(F.sum("count"), F.count(F.lit(1))).first()
    weights = sizes.select("label", (F.lit(float(n)) / (F.col("count") * float(classes))).alias("weight"))
    ready = train.join(F.broadcast(weights), "label").select(F.col("label").cast("double").alias("label"), "weight", array_to_vector("z").alias("features"))
    model = OneVsRest(classifier=LinearSVC(maxIter=max_iter), weightCol="weight").fit(ready)
    shown = model.transform(test.select("id", F.col("label").cast("double").alias("label"), array_to_vector("z").alias("features")))
    return shown.select("id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))


def timed_assignment(points: DataFrame, centroids: np.ndarray, rows: int = 1000) -> DataFrame:
    """(n, mean_s, std_s): seconds to assign single points, measured inside the tasks on up to ``rows`` points of each."""
    ship(points.sparkSession)
    held = points.sparkSession.sparkContext.broadcast(np.asarray(centroids, np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        spent = []
        for batch in batches:
            for row in matrix(batch.column("x"))[: rows - len(spent)] if batch.num_rows else []:
                began = time.process_time()
                nearest(row[None, :], held.value)
                spent.append(time.process_time() - began)
        yield pa.RecordBatch.from_arrays([pa.array(spent, type=pa.float64())], names=["s"])

    times = points.select("x").mapInArrow(run, "s double")
    return times.agg(F.count("s").alias("n"), F.avg("s").alias("mean_s"), F.stddev_pop("s").alias("std_s"))


@dataclass(frozen=True)
class Limited:
    """What an action gave within its time, or that it was stopped."""

    result: object
    seconds: float
    stopped: bool


def limited(spark: SparkSession, seconds: float, action: Callable[[], object]) -> Limited:
    """Runs an action whose Spark jobs are cancelled after ``seconds``; the session goes on.

    The jobs of the calling thread carry a tag of this call's, which is what is cancelled: others' jobs run on. An error that
    is not the cancellation's is raised.
    """
    sc, tag = spark.sparkContext, f"limited-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        # jobs that the action starts between two others' end are met as well
        while not done.wait(0.2):
            sc.cancelJobsWithTag(tag)

    done = threading.Event()
    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    began = time.perf_counter()
    timer.start()
    try:
        result, stopped = action(), False
    except Exception:
        if not late.is_set():
            raise
        result, stopped = None, True
    finally:
        done.set()
        timer.cancel()
        sc.removeJobTag(tag)
    return Limited(result, time.perf_counter() - began, stopped)


def baseline_record(spark: SparkSession, pruned: Callable[[], DataFrame], baseline: Callable[[], DataFrame], factor: float = 10.0) -> dict:
    """Seconds of a pruned search and of a baseline that may take ``factor`` times as long; its seconds are null if it is stopped."""
    began = time.perf_counter()
    pruned().write.format("noop").mode("overwrite").save()
    own = time.perf_counter() - began
    found = limited(spark, factor * own, lambda: baseline().write.format("noop").mode("overwrite").save())
    return {"pruned_s": own, "baseline_s": None if found.stopped else found.seconds, "stopped": found.stopped}


def observed_assignment(points: DataFrame, centroids: np.ndarray, write: Callable[[DataFrame], None]) -> dict:
    """Assigns all points, hands them to ``write`` and says what passed by, without a second pass: rows, vector bytes, cost, seconds."""
    metrics = Observation()
    sized = assign(points.select("id", "x"), centroids, keep=("id", "x"))
    seen = sized.observe(metrics, F.count(F.lit(1)).alias("rows"), F.sum(F.size("x") * 8).alias("bytes"), F.sum("d2").alias("cost"))
    began = time.perf_counter()
    write(seen.drop("x"))
    return metrics.get | {"seconds": time.perf_counter() - began}
