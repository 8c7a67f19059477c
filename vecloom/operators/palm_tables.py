"""Factorisation of matrices that are tables (i, j, v): the proximal iteration of ``factorize`` on relations.

Nothing of a matrix reaches the driver, so K and d may be of any size: gradients are products (joins on the shared index
with partial sums before the shuffle), projections are rank filters, the scale and the objective one aggregate. Each
factor is written once it is made, so a sweep's lineage is short; the driver holds the scale, the step and the trace.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.durable import materialize, release
from vecloom.operators.chain import difference, multiply
from vecloom.operators.factorize import Const, Constraint, Step, TopRowCol
from vecloom.operators.projections import top_rows_and_columns


@dataclass(frozen=True)
class Matrix:
    """A table of non-zeros and the size of the matrix."""

    rows: int
    cols: int
    table: DataFrame

    def of(self, table: DataFrame) -> Matrix:
        return Matrix(self.rows, self.cols, table)


def transposed(table: DataFrame) -> DataFrame:
    return table.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def scaled(table: DataFrame, factor: float) -> DataFrame:
    return table.select("i", "j", (F.col("v") * factor).alias("v"))


def added(*tables: DataFrame) -> DataFrame:
    """The sum of matrices; entries that cancel to zero are left out."""
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return whole.groupBy("i", "j").agg(F.sum("v").alias("v")).filter("v <> 0")


def times(a: Matrix | None, b: Matrix | None) -> Matrix | None:
    """The product; None is the identity."""
    if a is None or b is None:
        return b if a is None else a
    return Matrix(a.rows, b.cols, multiply(a.table, b.table))


def identity(spark, rows: int, cols: int) -> Matrix:
    n = F.col("id")
    return Matrix(rows, cols, spark.range(min(rows, cols)).select(n.cast("int").alias("i"), n.cast("int").alias("j"), F.lit(1.0).alias("v")))


def zeros(spark, rows: int, cols: int) -> Matrix:
    return Matrix(rows, cols, spark.createDataFrame([], "i int, j int, v double"))


def frobenius(table: DataFrame) -> float:
    return float(table.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0) ** 0.5


def spectral_norm(m: Matrix, start: DataFrame | None = None, rounds: int = 200, tolerance: float = 1e-9, squarings: int = 5) -> tuple[float, DataFrame | None]:
    """The largest singular value by power iteration on the smaller side, and the vector (i, v) to start from next time.

    The side's Gram matrix is made once and squared ``squarings`` times, each time over its norm, so a round is one join for
    2 ** squarings steps. Stops when the value changes by a share of at most ``tolerance``; if it does not in
    ``rounds`` rounds, the bound by row and column sums, which is never too small, is the answer. 0 for no non-zeros.
    """
    spark = m.table.sparkSession
    a = m.table if m.rows <= m.cols else transposed(m.table)
    gram = materialize(multiply(a, transposed(a)), "gram")
    trace = frobenius(gram)
    if trace == 0.0:
        return 0.0, None
    power = gram
    for _ in range(squarings):
        size = frobenius(power)
        made = materialize(multiply(scaled(power, 1 / size), scaled(power, 1 / size)), "gram")
        if power is not gram:
            release(power)
        power = made
    side = lambda t: t.select("i").distinct().select("i", F.lit(1.0).alias("v"))
    # a warm start that lies in the kernel would stay there, so every index has a part of it
    v = side(gram) if start is None else side(gram).alias("s").join(start.alias("w"), "i", "left").select("i", (F.coalesce("w.v", F.lit(0.0)) + F.col("s.v") * 1e-3).alias("v"))
    v, before = materialize(v, "vector"), 0.0
    for _ in range(rounds):
        made = power.join(v.select(F.col("i").alias("j"), F.col("v").alias("x")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))
        size = float(made.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0) ** 0.5
        if size == 0.0:
            break
        made = materialize(made.select("i", (F.col("v") / size).alias("v")), "vector")
        release(v)
        v = made
        x = v.select(F.col("i").alias("j"), F.col("v").alias("x"))
        y = v.select("i", F.col("v").alias("y"))
        now = float(gram.join(x, "j").join(y, "i").agg(F.sum(F.col("v") * F.col("x") * F.col("y"))).first()[0] or 0.0) ** 0.5
        if abs(now - before) <= tolerance * now:
            return now, v
        before = now
    sums = [float(spark_sum.agg(F.max("s")).first()[0]) for spark_sum in (m.table.groupBy(k).agg(F.sum(F.abs("v")).alias("s")) for k in ("i", "j"))]
    return (sums[0] * sums[1]) ** 0.5, v


def projected(m: Matrix, constraint: Constraint) -> Matrix:
    return m.of(top_rows_and_columns(m.table, m.rows, m.cols, constraint.total)) if isinstance(constraint, TopRowCol) else m


@dataclass
class Tables:
    """Like ``factorize.Factorization``; the objective of a sweep is in ``trace`` behind the one before the first."""

    scale: float
    factors: list[Matrix]
    trace: list[float]

    @property
    def chain(self) -> DataFrame:
        """(q, i, j, v)."""
        parts = [f.table.select(F.lit(q).alias("q"), "i", "j", "v") for q, f in enumerate(self.factors)]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole


def _product(factors: list[Matrix]) -> Matrix:
    out: Matrix | None = None
    for f in reversed(factors):
        out = times(f, out)
    return out


def palm(target: Matrix, factors: list[Matrix], constraints: list[Constraint], scale: float = 1.0, max_iter: int = 50, delta: float = 1e-6) -> Tables:
    """``factorize.palm`` on tables: the same steps, the same projections, the same traces."""
    if len(factors) != len(constraints):
        raise ValueError("a constraint for each factor is needed")
    if any(a.cols != b.rows for a, b in zip(factors, factors[1:])):
        raise ValueError("factors of these sizes have no product")
    factors = [f.of(materialize(f.table, "factor")) for f in factors]
    warm: dict[tuple[str, int], DataFrame | None] = {}

    def norm(side: str, j: int, m: Matrix | None) -> float:
        if m is None:
            return 1.0
        size, warm[side, j] = spectral_norm(m, warm.get((side, j)))
        return size

    fit = difference(target.table, _product(factors).table, scale).first()
    trace = [float(fit["error"])]
    for _ in range(max_iter):
        lefts: list[Matrix | None] = [None]
        for f in factors[:-1]:
            made = times(lefts[-1], f)
            lefts.append(made.of(materialize(made.table, "left")))
        right: Matrix | None = None
        for j in range(len(factors) - 1, -1, -1):
            if not isinstance(constraints[j], Const):
                left, s = lefts[j], factors[j]
                step = 1.001 * (scale * norm("left", j, left) * norm("right", j, right)) ** 2
                if step > 0:
                    part = times(times(left, s), right)
                    gap = target.of(materialize(added(scaled(part.table, scale), scaled(target.table, -1.0)), "gap"))
                    grad = gap if left is None else times(Matrix(left.cols, left.rows, transposed(left.table)), gap)
                    grad = grad if right is None else times(grad, Matrix(right.cols, right.rows, transposed(right.table)))
                    moved = s.of(materialize(added(s.table, scaled(grad.table, -scale / step)), "moved"))
                    new = projected(moved, constraints[j])
                    size = frobenius(new.table)
                    if size > 0:
                        factors[j] = s.of(materialize(scaled(new.table, 1 / size), "factor"))
                    release(moved.table)
                    release(gap.table)
            made = times(factors[j], right)
            right = made if right is None else made.of(materialize(made.table, "right"))
        for made in lefts[1:]:
            release(made.table)
        fit = difference(target.table, right.table, 1.0).first()
        scale = float(fit["scale"] or 0.0)
        trace.append(float(difference(target.table, right.table, scale).first()["error"]))
        if len(trace) > 2 and abs(trace[-2] - trace[-1]) <= delta * max(abs(trace[-2]), 1e-300):
            break
    return Tables(scale, factors, trace)


def start_factors(spark, left: int, right: int, n_factors: int) -> list[Matrix]:
    """Identities and a zero last factor."""
    a = min(left, right)
    shapes = [(left if q == 0 else a, right if q == n_factors - 1 else a) for q in range(n_factors)]
    return [identity(spark, *s) if q < n_factors - 1 else zeros(spark, *s) for q, s in enumerate(shapes)]


def hierarchical(target: Matrix, factors: list[Matrix], steps: list[Step], scale: float = 1.0, max_iter: int = 50, delta: float = 1e-6) -> tuple[Tables, list[tuple[list[float], list[float]]]]:
    """``factorize.hierarchical`` on tables, the residual on the right: split it in two, refit all factors so far, until every factor is split off."""
    done: list[Matrix] = []
    residual, traces, total = target, [], scale
    for k, step in enumerate(steps):
        split = palm(residual, [factors[k], _product(factors[k + 1 :])], step.split, scale if k == 0 else 1.0, max_iter, delta)
        total = split.scale if k == 0 else total * split.scale
        refit = palm(target, [*done, *split.factors], step.finetune, total, max_iter, delta)
        total = refit.scale
        done, residual = refit.factors[:-1], refit.factors[-1]
        traces.append((split.trace, refit.trace))
    return Tables(total, [*done, residual], traces[-1][1]), traces
