"""Factorisation of a K x d matrix into sparse factors by proximal alternating linearised minimisation.

Driver work by nature: the matrix is the centroids', not the data's. Factors stand left to right and are
updated right to left; each is a gradient step, a projection onto its constraint and a normalisation, and one
scale for all of them is fitted after every sweep.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from vecloom.operators.chain import Chain, spectral_norm
from vecloom.operators.projections import keep_rows_and_columns


@dataclass(frozen=True)
class Const:
    """The factor stays as it is."""


@dataclass(frozen=True)
class Ident:
    """Any matrix."""

    def project(self, m: np.ndarray) -> np.ndarray:
        return m


@dataclass(frozen=True)
class TopRowCol:
    """The union of the largest entries of rows and columns, ``total`` in all before the union."""

    total: int

    def project(self, m: np.ndarray) -> np.ndarray:
        return keep_rows_and_columns(m, self.total)


Constraint = Const | Ident | TopRowCol


@dataclass
class Factorization:
    scale: float
    factors: list[np.ndarray]
    #: objective before the first sweep and after each
    trace: list[float]

    @property
    def product(self) -> np.ndarray:
        """Without the scale."""
        return Chain(self.factors).product()

    @property
    def matrix(self) -> np.ndarray:
        return self.scale * self.product


def objective(target: np.ndarray, scale: float, product: np.ndarray) -> float:
    return float(((target - scale * product) ** 2).sum())


def best_scale(target: np.ndarray, product: np.ndarray) -> float:
    """The scale of least squared error; 0 for a zero product."""
    size = float((product * product).sum())
    return float((target * product).sum()) / size if size else 0.0


def palm(target: np.ndarray, factors: list[np.ndarray], constraints: list[Constraint], scale: float = 1.0, max_iter: int = 50, delta: float = 1e-6) -> Factorization:
    """Flat factorisation from given factors and scale.

    A factor that its projection makes zero keeps its last value instead of being divided by zero.
    """
    factors = [np.array(f, np.float64) for f in factors]
    if len(factors) != len(constraints):
        raise ValueError("a constraint for each factor is needed")
    Chain(factors)
    warm: dict[tuple[str, int], np.ndarray] = {}

    def norm(side: str, j: int, m: np.ndarray | None) -> float:
        if m is None:
            return 1.0
        size, warm[side, j] = spectral_norm(m, warm.get((side, j)))
        return size

    trace = [objective(target, scale, Chain(factors).product())]
    for _ in range(max_iter):
        lefts: list[np.ndarray | None] = [None]
        for f in factors[:-1]:
            lefts.append(f if lefts[-1] is None else lefts[-1] @ f)
        right: np.ndarray | None = None
        for j in range(len(factors) - 1, -1, -1):
            if not isinstance(constraints[j], Const):
                left, s = lefts[j], factors[j]
                step = 1.001 * (scale * norm("left", j, left) * norm("right", j, right)) ** 2
                if step > 0:
                    part = s if left is None else left @ s
                    gap = scale * (part if right is None else part @ right) - target
                    grad = gap if left is None else left.T @ gap
                    grad = grad if right is None else grad @ right.T
                    new = constraints[j].project(s - scale / step * grad)
                    size = np.linalg.norm(new)
                    if size > 0:
                        factors[j] = new / size
            right = factors[j] if right is None else factors[j] @ right
        scale = best_scale(target, right)
        trace.append(objective(target, scale, right))
        if len(trace) > 2 and abs(trace[-2] - trace[-1]) <= delta * max(abs(trace[-2]), 1e-300):
            break
    return Factorization(scale, factors, trace)


@dataclass(frozen=True)
class Step:
    split: list[Constraint]
    finetune: list[Constraint]


def budgets(left: int, right: int, n_factors: int, sparsity: int, residual_on_right: bool = True, constant_first: bool = False) -> list[Step]:
    """Constraints of each hierarchical step for a chain of n_factors (a constant first one included).

    Inner factors get sparsity * A entries, A = min(left, right), the outermost sparsity times their long
    side; the residual is halved in each step and never gets fewer than an inner factor. On the right it becomes the
    outer factor in the last step and gets no fewer than that, save in the refit of a second step.
    """
    top, a, last = TopRowCol, min(left, right), n_factors - 2
    inner, outer_left, outer_right = top(sparsity * a), top(sparsity * left), top(sparsity * right)
    constant: list[Constraint] = [Const()] if constant_first else []
    steps: list[Step] = []
    for k in range(n_factors - 1):
        # which of the factors after the constant one is split off: -1 for the constant itself
        place = k - len(constant)
        if residual_on_right:
            rest = top(max(inner.total, int(right * a / 2 ** (place + 1))))
            settled = [*constant, outer_left, *[inner] * k][: k + 1]
            final = top(max(outer_right.total, rest.total)) if k == last and place > 0 else rest
            end: Constraint = Ident() if place < 0 else final
            first = outer_left if k == last and place > 0 else settled[k]
            steps.append(Step([first, end], [*settled, rest if k == 1 else end]))
        else:
            rest = top(max(inner.total, int(left * a / 2 ** (k + 1))))
            settled = [*[inner] * k, outer_right]
            if k < last:
                steps.append(Step([rest, settled[0]], [rest, *settled]))
            elif constant_first:
                steps.append(Step([Const(), outer_left], [Const(), outer_left, *settled[1:]]))
            else:
                steps.append(Step([rest, inner], [outer_left, *settled]))
    return steps


def flat_budget(left: int, right: int, n_factors: int, sparsity: int, constant_first: bool = False) -> list[Constraint]:
    a = min(left, right)
    head: list[Constraint] = [Const()] if constant_first else []
    return [*head, TopRowCol(sparsity * left), *[TopRowCol(sparsity * a)] * (n_factors - 2 - len(head)), TopRowCol(sparsity * right)]


def start_factors(left: int, right: int, n_factors: int, constant_first: bool = False) -> list[np.ndarray]:
    """Identities and a zero last factor; with a constant first one, I / sqrt(left) before them."""
    a = min(left, right)
    chain = [np.eye(left) / np.sqrt(left)] if constant_first else []
    n = n_factors - len(chain)
    shapes = [(left if q == 0 else a, right if q == n - 1 else a) for q in range(n)]
    return chain + [np.eye(*s) if q < n - 1 else np.zeros(s) for q, s in enumerate(shapes)]


def hierarchical(
    target: np.ndarray, factors: list[np.ndarray], steps: list[Step], scale: float = 1.0, residual_on_right: bool = True, max_iter: int = 50, delta: float = 1e-6
) -> tuple[Factorization, list[tuple[list[float], list[float]]]]:
    """Splits the residual in two, then refits all factors so far to the whole target, until every factor is split off.

    Returns the factorisation and the traces of each step's split and refit.
    """
    done: list[np.ndarray] = []
    residual, traces, total = target, [], scale
    start = [np.array(f, np.float64) for f in factors]
    for k, step in enumerate(steps):
        if residual_on_right:
            pair = [start[k], Chain(start[k + 1 :]).product()]
        else:
            cut = len(start) - k - 1
            pair = [Chain(start[:cut]).product(), start[cut]]
        split = palm(residual, pair, step.split, scale if k == 0 else 1.0, max_iter, delta)
        total = split.scale if k == 0 else total * split.scale
        now = [*done, *split.factors] if residual_on_right else [*split.factors, *done]
        refit = palm(target, now, step.finetune, total, max_iter, delta)
        total = refit.scale
        done, residual = (refit.factors[:-1], refit.factors[-1]) if residual_on_right else (refit.factors[1:], refit.factors[0])
        traces.append((split.trace, refit.trace))
    out = [*done, residual] if residual_on_right else [residual, *done]
    return Factorization(total, out, traces[-1][1]), traces
