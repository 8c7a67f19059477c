"""K-means whose centroid matrix is a scaled product of sparse factors.

Each iteration is one distributed pass (assignment, counts, sums) and one factorisation of the K x d weighted
means on the driver. By default a pass gives the executors the dense product: at a few hundred dimensions one matrix product
per batch beats a chain of sparse ones. With ``by_chain`` passes apply the sparse factors one after the other, which is what
pays where K and d are large; ``transform`` can do so with a finished model. With ``batch_size`` a pass is a job a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vecloom.operators.chain import Chain
from vecloom.operators.dense import BLOCK, Sums, assign, folded, matrix, pass_over
from vecloom.operators.factorize import Constraint, Factorization, Step, budgets, flat_budget, hierarchical, palm, start_factors
from vecloom.operators.lloyd import batch_pass, batched, repair
from vecloom.shipping import ship


@dataclass
class FactorizedKMeansModel:
    scale: float
    factors: list[np.ndarray]
    counts: np.ndarray
    #: objective of each iteration's assignment centroids
    trace: list[float] = field(default_factory=list)
    #: objectives of each factorisation, the initial one first
    factor_traces: list[list[float]] = field(default_factory=list)

    @property
    def chain(self) -> Chain:
        return Chain([self.scale * self.factors[0], *self.factors[1:]]).sparse()

    @property
    def centroids(self) -> np.ndarray:
        return self.chain.product()

    @property
    def n_param(self) -> int:
        return Chain(self.factors).non_zeros()

    def transform(self, points: DataFrame, keep: tuple[str, ...] = ("id",), factored: bool = False) -> DataFrame:
        """``keep`` columns, k and d2. factored: by the sparse factors one after the other instead of their product."""
        return assign_factored(points, self.chain, keep) if factored else assign(points, self.centroids, keep=keep)


def assign_factored(points: DataFrame, chain: Chain, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """The assignment to the rows of a chain, which goes to the executors as its non-zeros and is multiplied factor by factor.

    Among centroids as near as rounding can tell the lowest is taken.
    """
    ship(points.sparkSession)
    held = points.sparkSession.sparkContext.broadcast((chain, (chain.product() ** 2).sum(axis=1)))
    schema = ", ".join(f"{n} {t}" for n, t in points.select(*keep).dtypes) + ", k int, d2 double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, norms = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = matrix(part.column("x"))
                score = norms - 2 * factors.dot(x.T).T
                best = score.min(axis=1, keepdims=True)
                k = (score <= best + 1e-9 * (1 + np.abs(best) + norms.max(initial=0))).argmax(axis=1)
                d2 = np.maximum(score[np.arange(len(x)), k] + (x * x).sum(axis=1), 0)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(k.astype(np.int32)), pa.array(d2)], names=[*keep, "k", "d2"])

    return points.select(*dict.fromkeys([*keep, "x"])).mapInArrow(run, schema)


def chain_pass(points: DataFrame, chain: Chain) -> Sums:
    """``pass_over`` with an assignment by the factors."""
    return folded(assign_factored(points, chain, ("x",)), *chain.shape)


def default_factors(k: int, d: int) -> int:
    return max(2, int(np.log2(max(k, d))))


def factorized_kmeans(
    points: DataFrame,
    centroids: np.ndarray,
    n_factors: int | None = None,
    sparsity: int = 2,
    max_iter: int = 5,
    delta: float = 1e-6,
    palm_iter: int = 30,
    residual_on_right: bool | None = None,
    hierarchical_init: bool = False,
    hierarchical_inside: bool = False,
    empty: str = "farthest",
    seed: int = 0,
    by_chain: bool = False,
    batch_size: int | None = None,
    key: str = "id",
) -> FactorizedKMeansModel:
    """Assign, average, factorise sqrt(n)-weighted means with a diagonal first factor, repeat.

    With diag(sqrt(n_k / n)) fixed as the first factor the fit weighs each centroid by its members, and the
    remaining factors, scaled by 1/sqrt(n), are the new centroids. The factors of the last iteration are
    returned together with their own scale.
    """
    u = np.array(centroids, np.float64)
    k, d = u.shape
    n_factors = n_factors or default_factors(k, d)
    on_right = d >= k if residual_on_right is None else residual_on_right
    start = start_factors(k, d, n_factors + 1, constant_first=True)
    steps: list[Step] = budgets(k, d, n_factors + 1, sparsity, on_right, constant_first=True)
    flat: list[Constraint] = flat_budget(k, d, n_factors + 1, sparsity, constant_first=True)

    def factorise(target: np.ndarray, chain: list[np.ndarray], scale: float, in_steps: bool) -> Factorization:
        if in_steps:
            return hierarchical(target, chain, steps, scale, on_right, palm_iter, delta)[0]
        return palm(target, chain, flat, scale, palm_iter, delta)

    found = factorise(u, start, 1.0, hierarchical_init or hierarchical_inside)
    model = FactorizedKMeansModel(found.scale / np.sqrt(k), found.factors[1:], np.zeros(k, np.int64), factor_traces=[found.trace])
    batches = batched(points, key, batch_size) if batch_size else None
    n = None
    for it in range(max_iter):
        now = model.centroids
        one = (lambda some, _: chain_pass(some, model.chain)) if by_chain else pass_over  # noqa: B023
        got = batch_pass(batches, now, one) if batches else one(points, now)
        n = got.counts.sum() if n is None else n
        if n == 0:
            break
        means, counts = repair(points, now, got, empty, seed)
        model.trace.append(float(got.objective.sum()))
        root = np.sqrt(np.maximum(counts, 0))
        found = factorise(root[:, None] * means, [np.diag(root / np.sqrt(n)), *model.factors], model.scale * np.sqrt(n), hierarchical_inside)
        model.factors, model.scale, model.counts = found.factors[1:], found.scale / np.sqrt(n), counts
        model.factor_traces.append(found.trace)
        if it and abs(model.trace[-2] - model.trace[-1]) <= delta * max(abs(model.trace[-2]), 1e-300):
            break
    return model


def factorized_after_kmeans(centroids: np.ndarray, n_factors: int | None = None, sparsity: int = 2, palm_iter: int = 50, delta: float = 1e-6) -> FactorizedKMeansModel:
    """The factorisation of finished centroids; assign again with ``transform``."""
    u = np.array(centroids, np.float64)
    k, d = u.shape
    n = n_factors or default_factors(k, d)
    found, _ = hierarchical(u, start_factors(k, d, n), budgets(k, d, n, sparsity, True, False), 1.0, True, palm_iter, delta)
    return FactorizedKMeansModel(found.scale, found.factors, np.zeros(k, np.int64), factor_traces=[found.trace])
