"""RBF kernels, Nystrom embeddings and their error.

Landmarks are few (K x d on the driver); points are embedded where they stand. Errors are those of all pairs of points,
by blocks, or of a bounded sample's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.functions.vectors import sq_dist, sq_norm
from vecloom.operators.blocks import packed, pairs, vectors
from vecloom.operators.chain import hadamard_sign
from vecloom.operators.dense import BLOCK, matrix, small
from vecloom.operators.lloyd import first_by_hash
from vecloom.operators.positions import with_position
from vecloom.shipping import ship


#: Kernel values of two blocks that are in memory at a time: what a core's cache holds.
CELLS = 65_536


def rbf(d2: Column, gamma: float) -> Column:
    return F.exp(F.greatest(d2, F.lit(0.0)) * -gamma)


def kernel_table(points: DataFrame, landmarks: DataFrame, gamma: float) -> DataFrame:
    """(id, k, v): the kernel of each point with each row of a small table (k, u)."""
    return points.join(F.broadcast(small(landmarks))).select("id", "k", rbf(sq_dist(F.col("x"), F.col("u")), gamma).alias("v"))


def rbf_matrix(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    d2 = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    if x is y:
        np.fill_diagonal(d2, 0.0)
    return np.exp(-gamma * np.maximum(d2, 0))


def gamma_heuristic(points: DataFrame, block: int = 1000) -> DataFrame:
    """One row, gamma = 1 / mean over blocks of consecutive ids of the mean squared distance inside the block.

    A block's mean over all pairs is 2 (E|x|^2 - |E x|^2), so no pairs are made. Rows after the last whole
    block do not count; with fewer rows than a block, all are one block. No rows: null.
    """
    n = points.count()
    size = min(block, n) or 1
    placed = with_position(points.select("id", "x"), "id").withColumn("block", F.floor(F.col("pos") / size)).filter(F.col("block") < n // size)
    norms = placed.groupBy("block").agg(F.avg(sq_norm(F.col("x"))).alias("norm"))
    means = placed.select("block", F.posexplode("x").alias("i", "v")).groupBy("block", "i").agg(F.avg("v").alias("m")).groupBy("block").agg(F.sum(F.col("m") * F.col("m")).alias("mean"))
    spread = norms.join(means, "block").select(((F.col("norm") - F.col("mean")) * 2).alias("d2"))
    return spread.agg((F.lit(1.0) / F.avg("d2")).alias("gamma"))


@dataclass
class Nystrom:
    landmarks: np.ndarray
    gamma: float

    def __post_init__(self):
        """The square root of the inverse of the landmarks' kernel, by its decomposition with a floor for small values."""
        u, s, vt = np.linalg.svd(rbf_matrix(self.landmarks, self.landmarks, self.gamma))
        self.root = u @ np.diag(1 / np.sqrt(np.maximum(s, 1e-12))) @ vt

    def embed(self, x: np.ndarray) -> np.ndarray:
        return rbf_matrix(x, self.landmarks, self.gamma) @ self.root

    def transform(self, points: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
        """``keep`` columns and z array<double>, one value a landmark."""
        ship(points.sparkSession)
        held = points.sparkSession.sparkContext.broadcast(self)
        schema = ", ".join(f"{n} {t}" for n, t in points.select(*keep).dtypes) + ", z array<double>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    z = held.value.embed(matrix(part.column("x")))
                    offsets = pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32))
                    column = pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], column], names=[*keep, "z"])

        return points.select(*keep, "x").mapInArrow(run, schema)


def reconstruction_error(points: DataFrame, model: Nystrom, sample: int = 2000, seed: int = 0) -> float:
    """|ZZ' - K| / |K| in Frobenius norm on at most ``sample`` points by hash order; the sample is the driver's."""
    x = first_by_hash(points, sample, seed)
    exact = rbf_matrix(x, x, model.gamma)
    z = model.embed(x)
    return float(np.linalg.norm(z @ z.T - exact) / np.linalg.norm(exact))


def kernel_errors_of(points: DataFrame, models: dict[str, Nystrom], rows: int = 2048) -> DataFrame:
    """(name, gap, exact) of each model: squared Frobenius norms of ZZ' - K and of K over all pairs of points, exactly.

    Points are packed into blocks of at most ``rows``, written once; each pair of blocks, of which the kernel's symmetry leaves
    a triangle, is embedded and compared where it meets. Models of one gamma share the kernel. A task returns one row a model: no
    pair of points becomes a row, and no point is shuffled.
    """
    held = points.sparkSession.sparkContext.broadcast(models)
    gammas, cells = sorted({m.gamma for m in models.values()}), CELLS
    blocks = packed(points, rows, tag="kernel-blocks")

    def augmented(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two matrices whose product, of two blocks, is minus the squared distances."""
        n, one = np.einsum("ij,ij->i", x, x)[:, None], np.ones((len(x), 1))
        return np.hstack([2 * x, -n, -one]), np.hstack([x, one, n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap, exact = dict.fromkeys(held.value, 0.0), dict.fromkeys(gammas, 0.0)
        last, some = None, False
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = batch.column("a_block")[r].as_py(), batch.column("b_block")[r].as_py()
                if a != last:
                    x, last = vectors(batch, r, "a_"), a
                    left, z = augmented(x)[0], {name: m.embed(x) for name, m in held.value.items()}
                y = vectors(batch, r, "b_")
                right, w = augmented(y)[1].T, {name: m.embed(y).T for name, m in held.value.items()}
                step, times, some = max(1, cells // len(y)), 1.0 if a == b else 2.0, True
                for at in range(0, len(x), step):
                    d2 = np.minimum(left[at : at + step] @ right, 0)
                    for gamma in gammas:
                        k = np.exp(d2 * gamma)
                        if a == b:
                            k[np.arange(len(k)), np.arange(at, at + len(k))] = 1.0
                        exact[gamma] += times * float(np.vdot(k, k))
                        for name, m in held.value.items():
                            if m.gamma == gamma:
                                e = z[name][at : at + step] @ w[name]
                                e -= k
                                gap[name] += times * float(np.vdot(e, e))
        if some:
            names = list(held.value)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([gap[n] for n in names]), pa.array([exact[held.value[n].gamma] for n in names])], names=["name", "gap", "exact"])

    met = pairs(blocks, blocks, F.col("a_block") <= F.col("b_block"))
    found = met.mapInArrow(run, "name string, gap double, exact double")
    return found.groupBy("name").agg(F.sum("gap").alias("gap"), F.sum("exact").alias("exact"))


def kernel_errors(points: DataFrame, model: Nystrom, rows: int = 2048) -> DataFrame:
    """One row (gap, exact) of one model, null without points."""
    return kernel_errors_of(points, {"": model}, rows).agg(F.sum("gap").alias("gap"), F.sum("exact").alias("exact"))


def kernel_error_of(points: DataFrame, models: dict[str, Nystrom], rows: int = 2048) -> dict[str, float]:
    """|ZZ' - K| / |K| in Frobenius norm over all points, of each model."""
    found = {r["name"]: r for r in kernel_errors_of(points, models, rows).collect()}  # one row a model
    return {name: float(np.sqrt(found[name]["gap"] / found[name]["exact"])) if name in found and found[name]["exact"] else 0.0 for name in models}


def kernel_error(points: DataFrame, model: Nystrom, rows: int = 2048) -> float:
    """|ZZ' - K| / |K| in Frobenius norm over all points."""
    return kernel_error_of(points, {"": model}, rows)[""]


def structured(seeds: np.ndarray, n: int | None = None) -> np.ndarray:
    """Rows of Hadamard * diag(seed) for each seed, padded to a power of two; the first n of them."""
    d = 1 << int(np.ceil(np.log2(seeds.shape[1])))
    i = np.arange(d)
    sign = 1 - 2 * (np.bitwise_count(i[:, None] & i[None, :]) % 2).astype(np.float64)
    padded = np.pad(seeds, ((0, 0), (0, d - seeds.shape[1])))
    return (sign[None, :, :] * padded[:, None, :]).reshape(-1, d)[:n]


def landmark_families(points: DataFrame, k: int, kmeans_centroids: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """Five ways to choose k landmarks: K-means, uniform rows, structured from rows, rows as seeds, structured from K-means."""
    d = kmeans_centroids.shape[1]
    n_seeds = k // d + 1
    rows = first_by_hash(points, max(k, n_seeds), seed)
    return {
        "kmeans": kmeans_centroids[:k],
        "uniform": rows[:k],
        "structured": structured(rows[:n_seeds], k)[:, :d],
        "seeds": rows[:n_seeds],
        "structured_kmeans": structured(kmeans_centroids[:n_seeds], k)[:, :d],
    }


__all__ = ["Nystrom", "gamma_heuristic", "hadamard_sign", "kernel_table", "landmark_families", "rbf", "rbf_matrix", "reconstruction_error", "structured"]
