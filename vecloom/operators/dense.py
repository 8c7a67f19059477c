"""Points against a small set of centroids: distances, assignment, objective, means.

Points stay where they are. Centroids (K x d, driver-sized by definition) go to the executors once a pass;
Arrow batches are multiplied against them as matrices, and only the assignment or K partial sums come back.
Native forms that never leave the JVM are here too, for small K and for plans that SQL must read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.durable import materialize, release
from vecloom.functions.vectors import dot, sq_dist
from vecloom.shipping import ship

#: Rows that are embedded or compared at a time.
BLOCK = 4096
#: Scores and differences that a search holds at a time, and the rows of u that meet in a tile of them: its memory does not grow with either side.
SCORES, TILE = 2_000_000, 2048
#: Centroid values that a task holds at most (64 MB of doubles); more are compared block by block.
MAX_CENTROID_VALUES = 8_000_000
#: Centroid values that stand as literals in a plan at most.
MAX_LITERAL_VALUES = 20_000


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, -1)


def nearest(x: np.ndarray, u: np.ndarray, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of u for each row of x (the lowest of ties), and the squared distance.

    ``within``: squared distances known already, in no case changed; -1 and that distance where no row of u is as near.

    The matrix form |u|^2 - 2xu finds candidates, in tiles of both sides; all that are within rounding of a tile's best, and
    may be nearer than the best so far, are compared by squared differences.
    """
    k, d2 = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    if within is not None:
        k, d2 = np.where(np.isinf(within), 0, -1), np.nextafter(within, np.inf)  # what is as near counts
    norms, own_norms = np.einsum("ij,ij->i", u, u), np.einsum("ij,ij->i", x, x)
    largest = norms.max(initial=0)
    at_once = max(1, SCORES // max(1, u.shape[1]))
    for at in range(0, len(u), TILE):
        some = u[at : at + TILE]
        scaled = some * -2.0
        step = max(1, min(BLOCK, SCORES // max(some.shape)))
        for b in range(0, len(x), step):
            part = x[b : b + step]
            score = part @ scaled.T
            score += norms[at : at + TILE]
            best = score.min(axis=1)
            limit = best + 1e-9 * (1 + np.abs(best) + largest)
            rows = np.flatnonzero(best + own_norms[b : b + step] <= d2[b : b + step] + 1e-9 * (1 + own_norms[b : b + step] + largest))
            i, j = np.nonzero((score if len(rows) == len(part) else score[rows]) <= limit[rows, None])
            i = rows[i]
            for c in range(0, len(i), at_once):
                own, name = i[c : c + at_once], j[c : c + at_once]
                exact = ((part[own] - some[name]) ** 2).sum(axis=1)
                if len(i) > len(rows):
                    order = np.lexsort((name, exact, own))
                    order = order[np.flatnonzero(np.diff(own[order], prepend=-1))]
                    own, name, exact = own[order], name[order], exact[order]
                nearer = exact < d2[b + own]
                own = b + own[nearer]
                k[own], d2[own] = at + name[nearer], exact[nearer]
    lost = np.isinf(d2)
    if lost.any():  # no comparison holds for what is not a number
        d2[lost] = ((x[lost] - u[0]) ** 2).sum(axis=1)
    return k, d2 if within is None else np.where(k < 0, within, d2)


def assign(points: DataFrame, centroids: np.ndarray, keys: list[int] | None = None, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """``keep`` columns, k and d2 of each point, the lowest k of ties. ``keys``: names of the centroids if they are not 0..K-1, ascending.

    More centroids than a task may hold are compared a block at a time, the best so far going from one to the next.
    """
    ship(points.sparkSession)
    centroids = np.asarray(centroids, np.float64)
    blocks = blocks_of(centroids)
    if len(blocks) > 1:
        names = np.array(keys if keys is not None else range(len(centroids)))
        found = points.select(*dict.fromkeys([*keep, "x"]), F.lit(None).cast("int").alias("_k"), F.lit(float("inf")).alias("_d2"))
        for a, b in blocks:
            part = assign(found, centroids[a:b], names[a:b].tolist(), (*dict.fromkeys([*keep, "x"]), "_k", "_d2"))
            better = F.col("d2") < F.col("_d2")
            found = part.select(*dict.fromkeys([*keep, "x"]), F.when(better, F.col("k")).otherwise(F.col("_k")).alias("_k"), F.when(better, F.col("d2")).otherwise(F.col("_d2")).alias("_d2"))
        return found.select(*keep, F.col("_k").alias("k"), F.col("_d2").alias("d2"))
    held = points.sparkSession.sparkContext.broadcast((centroids, np.array(keys if keys is not None else range(len(centroids)))))
    schema = ", ".join(f"{n} {t}" for n, t in points.select(*keep).dtypes) + ", k int, d2 double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, names = held.value
        for batch in batches:
            if batch.num_rows:
                k, d2 = nearest(matrix(batch.column("x")), u)
                columns = [batch.column(c) for c in keep] + [pa.array(names[k].astype(np.int32)), pa.array(d2)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "k", "d2"])

    return points.select(*dict.fromkeys([*keep, "x"])).mapInArrow(run, schema)


def blocks_of(centroids: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of centroids that a task may hold each, a centroid at least."""
    step = max(1, MAX_CENTROID_VALUES // max(1, centroids.shape[1])) if centroids.size else 1
    return [(a, min(a + step, len(centroids))) for a in range(0, max(1, len(centroids)), step)]


def assign_native(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The same in the JVM, with centroids as a literal: for few centroids."""
    u = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*[F.lit(float(v)) for v in row]).alias("u")) for k, row in enumerate(literal(centroids))])
    best = F.array_min(F.transform(u, lambda c: F.struct(sq_dist(F.col("x"), c["u"]).alias("d2"), c["k"].alias("k"))))
    return points.select("id", best.alias("best")).select("id", "best.k", "best.d2")


def distances(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """Every pair (id, k, d2) of points and a small table of centroids (k, u): n x K rows, which is the result asked for."""
    return points.join(F.broadcast(small(centroids))).select("id", "k", sq_dist(F.col("x"), F.col("u")).alias("d2"))


def small(centroids: DataFrame) -> DataFrame:
    """A table (k, u) that may be sent to every executor, by its size; an error otherwise."""
    values = centroids.agg(F.sum(F.size("u"))).first()[0] or 0
    if values > MAX_CENTROID_VALUES:
        raise ValueError("too many centroids to send to every executor")
    return centroids


def literal(centroids: np.ndarray) -> np.ndarray:
    """Centroids that may stand as literals in a plan; an error otherwise."""
    if centroids.size > MAX_LITERAL_VALUES:
        raise ValueError("too many centroids for literals of a plan: use assign")
    return centroids


def operator_scores(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, k and |u|^2 - 2 u.x of the nearest centroid: the assignment without the norm of the point. For few centroids."""
    u = F.array(
        *[F.struct(F.lit(k).alias("k"), F.lit(float((row * row).sum())).alias("n"), F.array(*[F.lit(float(v)) for v in row]).alias("u")) for k, row in enumerate(literal(centroids))]
    )
    best = F.array_min(F.transform(u, lambda c: F.struct((c["n"] - dot(c["u"], F.col("x")) * 2).alias("score"), c["k"].alias("k"))))
    return points.select("id", best.alias("best")).select("id", "best.k", "best.score")


@dataclass
class Sums:
    """What one pass over the points gives for each centroid."""

    counts: np.ndarray
    sums: np.ndarray
    objective: np.ndarray

    @property
    def means(self) -> np.ndarray:
        """Means of the members; an empty centroid's is zero."""
        return self.sums / np.maximum(self.counts, 1)[:, None]


#: Partial sums of all tasks are added in so many groups for each centroid, and these once more.
GROUPS = 64


def pass_over(points: DataFrame, centroids: np.ndarray) -> Sums:
    """Assigns the points and gathers K counts, sums, squared distances.

    Every task folds its rows into K partial sums; those of all tasks are folded again, as a stream, in GROUPS groups
    for each k and then by k. No row holds more than one vector, and K rows reach the driver. More centroids than a
    task may hold are assigned block by block, the assignment is written, and each block's members are folded on their own.
    """
    ship(points.sparkSession)
    centroids = np.asarray(centroids, np.float64)
    blocks = blocks_of(centroids)
    if len(blocks) > 1:
        placed = materialize(assign(points, centroids, keep=("x",)), "assigned")
        each = [folded(placed.filter((F.col("k") >= a) & (F.col("k") < b)).withColumn("k", F.col("k") - a), b - a, centroids.shape[1]) for a, b in blocks]
        release(placed)
        return Sums(*(np.concatenate([getattr(got, c) for got in each]) for c in ("counts", "sums", "objective")))
    return folded(points, len(centroids), centroids.shape[1], centroids)


def folded(points: DataFrame, n_k: int, d: int, centroids: np.ndarray | None = None) -> Sums:
    """The sums of points (x), which are assigned on the way, or of assigned points (k, x, d2)."""
    held = points.sparkSession.sparkContext.broadcast(centroids)
    def folded(counts: np.ndarray, sums: np.ndarray, objective: np.ndarray) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(counts)
        for at in range(0, len(some), 1024):
            part = some[at : at + 1024]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(part) * d + 1, d, dtype=np.int32)), pa.array(sums[part].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part]), lists, pa.array(objective[part])], names=["k", "n", "s", "o"])

    def zeros() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(n_k, np.int64), np.zeros((n_k, d)), np.zeros(n_k)

    def add(sums: np.ndarray, k: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(k, kind="stable")
        starts = np.flatnonzero(np.diff(k[order], prepend=-1))
        sums[k[order][starts]] += np.add.reduceat(x[order], starts, axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, (counts, sums, objective) = held.value, zeros()
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                k, d2 = nearest(x, u) if u is not None else (batch.column("k").to_numpy().astype(np.int64), batch.column("d2").to_numpy())
                counts += np.bincount(k, minlength=n_k)
                objective += np.bincount(k, d2, minlength=n_k)
                add(sums, k, x)
        yield from folded(counts, sums, objective)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, objective = zeros()
        for batch in batches:
            if batch.num_rows:
                k, n, o = (batch.column(c).to_numpy(zero_copy_only=False) for c in "kno")
                np.add.at(counts, k, n)
                np.add.at(objective, k, o)
                add(sums, k, matrix(batch.column("s")))
        yield from folded(counts, sums, objective)

    kind = "k int, n long, s array<double>, o double"
    parts = points.select("x", *([] if centroids is not None else ["k", "d2"])).mapInArrow(run, kind).withColumn("group", F.spark_partition_id() % GROUPS)
    found = parts.repartition("k", "group").select("k", "n", "s", "o").mapInArrow(fold, kind).repartition("k").mapInArrow(fold, kind).toArrow()  # K rows
    counts, sums, objective = zeros()
    if found.num_rows:
        k = found.column("k").to_numpy()
        counts[k], sums[k], objective[k] = found.column("n").to_numpy(), matrix(found.column("s")), found.column("o").to_numpy()
    return Sums(counts, sums, objective)


def means(assigned: DataFrame) -> DataFrame:
    """(k, pos, n, value): coordinate means of assigned points (k, x), natively; partial sums before the shuffle."""
    long = assigned.select("k", F.posexplode("x").alias("pos", "v"))
    return long.groupBy("k", "pos").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("value"))


def merge_means(old: DataFrame, new: DataFrame) -> DataFrame:
    """Weighted means of two tables (k, n, u): counts add up, and a side of no points leaves the other as it is."""
    both = old.select("k", F.col("n").alias("n1"), F.col("u").alias("u1")).join(new.select("k", F.col("n").alias("n2"), F.col("u").alias("u2")), "k", "full_outer")
    n1, n2 = F.coalesce("n1", F.lit(0)), F.coalesce("n2", F.lit(0))
    merged = F.zip_with("u1", "u2", lambda a, b: (a * n1 + b * n2) / (n1 + n2))
    chosen = F.when(n2 == 0, F.col("u1")).when(n1 == 0, F.col("u2")).otherwise(merged)
    return both.select("k", (n1 + n2).alias("n"), chosen.alias("u"))
