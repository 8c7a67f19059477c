"""Chains of sparse factors, as tables and as small driver objects.

A matrix is a table (i, j, v) of its non-zeros; a chain is (q, i, j, v) with factor q = 0 leftmost. Products are
joins on the shared index with partial sums before the shuffle. Points are multiplied where they stand, by sparse
factors that every task holds; only for factors too large for that the application is a join as well. ``Chain`` is
the driver's form for factors of K x d numbers, as factorisation makes them; its factors may be ``Sparse``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.vectors import bits, gray, hadamard_sign, sequency, walsh_hadamard
from vecloom.operators.dense import matrix, small
from vecloom.operators.lloyd import gaussian_value
from vecloom.shipping import ship


def multiply(left: DataFrame, right: DataFrame) -> DataFrame:
    """The product of two matrices."""
    a, b = left.select(F.col("i"), F.col("j").alias("m"), F.col("v").alias("a")), right.select(F.col("i").alias("m"), F.col("j"), F.col("v").alias("b"))
    return a.join(b, "m").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def factor(chain: DataFrame, q: int) -> DataFrame:
    return chain.filter(F.col("q") == q).select("i", "j", "v")


def product(chain: DataFrame, n_factors: int) -> DataFrame:
    """The whole chain's matrix, from the right."""
    return reduce(lambda done, q: multiply(factor(chain, q), done), range(n_factors - 2, -1, -1), factor(chain, n_factors - 1))


#: Non-zeros of all factors that go to every executor at most (16 bytes each).
MAX_HELD = 4_000_000


def apply_chain(chain: DataFrame, n_factors: int, points: DataFrame) -> DataFrame:
    """(id, i, v): the chain times each point (id, x), factor by factor from the right, never as one matrix.

    A null in x is NaN, and so is what it touches. Rows i are those that some path of non-zeros joins to a coordinate. Points stay where they are while the
    factors are few numbers; beyond MAX_HELD coordinates are joined to factors instead.
    """
    if chain.count() > MAX_HELD:
        return apply_by_join(chain, n_factors, points)
    rows = chain.select("q", "i", "j", F.col("v").cast("double").alias("v")).toArrow()
    q, i, j, v = (rows.column(c).to_numpy() for c in ("q", "i", "j", "v"))
    factors = [(i[q == f].astype(np.int64), j[q == f].astype(np.int64), v[q == f]) for f in range(n_factors)]
    ship(points.sparkSession)
    held = points.sparkSession.sparkContext.broadcast(factors)
    kind = points.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple[list[Sparse], np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = matrix(part.column("x"))
                if x.shape[1] not in made:
                    made[x.shape[1]] = _fitted(held.value, x.shape[1])
                parts, there = made[x.shape[1]]
                y = x.T
                for f in reversed(parts):
                    y = f @ y
                ids = part.column("id").take(pa.array(np.repeat(np.arange(part.num_rows), len(there))))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(there, part.num_rows).astype(np.int32)), pa.array(np.ascontiguousarray(y[there].T).ravel())], names=["id", "i", "v"])

    return points.select("id", "x").filter(F.size("x") > 0).mapInArrow(run, f"id {kind}, i int, v double")


def _fitted(factors: list[tuple[np.ndarray, np.ndarray, np.ndarray]], d: int) -> tuple[list[Sparse], np.ndarray]:
    """The factors as matrices for vectors of d values, and the rows that a path of non-zeros reaches from them."""
    width, there, out = d, np.arange(d), []
    for i, j, v in reversed(factors):
        keep = np.isin(j, there)
        height = int(i.max(initial=-1)) + 1
        out.append(Sparse((height, width), i[keep], j[keep], v[keep]))
        width, there = height, np.unique(i[keep])
    return out[::-1], there


def apply_by_join(chain: DataFrame, n_factors: int, points: DataFrame) -> DataFrame:
    """The same for factors of any size: n x d coordinates are joined to the factors, one by one."""
    moved = points.select("id", F.posexplode("x").alias("j", "b")).withColumn("b", F.coalesce("b", F.lit(float("nan"))))
    for q in range(n_factors - 1, -1, -1):
        part = factor(chain, q).select("i", "j", F.col("v").alias("a"))
        moved = moved.join(part, "j").groupBy("id", F.col("i").alias("j")).agg(F.sum(F.col("a") * F.col("b")).alias("b"))
    return moved.select("id", F.col("j").cast("int").alias("i"), F.col("b").cast("double").alias("v"))


def transpose(chain: DataFrame, n_factors: int) -> DataFrame:
    """The adjoint chain: factors in reverse order, rows and columns exchanged (real values)."""
    return chain.select((F.lit(n_factors - 1) - F.col("q")).alias("q"), F.col("j").alias("i"), F.col("i").alias("j"), "v")


def leftmost(chain: DataFrame, n_factors: int, n: int) -> DataFrame:
    """The first n factors; for n < 0 all but the last -n."""
    return chain.filter(F.col("q") < (n if n >= 0 else n_factors + n))


def rightmost(chain: DataFrame, n_factors: int, n: int) -> DataFrame:
    """The last n factors, numbered from 0; for n < 0 all but the first -n."""
    first = n_factors - n if n >= 0 else -n
    return chain.filter(F.col("q") >= first).withColumn("q", F.col("q") - first)


def difference(a: DataFrame, b: DataFrame, scale: float = 1.0) -> DataFrame:
    """One row: squared Frobenius norm of a - scale * b, and the scale that makes it least, null if b is zero."""
    both = a.select("i", "j", F.col("v").alias("a")).join(b.select("i", "j", F.col("v").alias("b")), ["i", "j"], "full_outer").na.fill(0.0, ["a", "b"])
    gap = F.col("a") - F.col("b") * scale
    return both.agg(F.sum(gap * gap).alias("error"), F.try_divide(F.sum(F.col("a") * F.col("b")), F.sum(F.col("b") * F.col("b"))).alias("scale"))


def non_zeros(chain: DataFrame) -> DataFrame:
    return chain.agg(F.count(F.when(F.col("v") != 0, 1)).alias("n_param"))


def hadamard(spark: SparkSession, n: int) -> DataFrame:
    """(i, j, v): the natural-order n x n Hadamard matrix, n a power of two: n * n rows, each from its number alone."""
    width = n.bit_length() - 1
    rows = spark.range(n * n).select(F.shiftright("id", width).alias("i"), F.col("id").bitwiseAND(F.lit(n - 1)).alias("j"))
    return rows.withColumn("v", hadamard_sign(F.col("i"), F.col("j")))


def hadamard_apply(points: DataFrame) -> DataFrame:
    """(id, i, v): every point's transform, unnormalised, natural order, in n log n steps where the row stands."""
    return points.select("id", F.posexplode(walsh_hadamard(F.col("x"))).alias("i", "v"))


def structured_apply(points: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, k, i, v): for each seed (k, u) the transform of u * x: the product of all its structured landmarks with x, never as a matrix.

    The landmarks are the rows of Hadamard * diag(u), so their products with x are one transform of n log n steps.
    """
    both = points.join(F.broadcast(small(seeds)))
    return both.select("id", "k", F.posexplode(walsh_hadamard(F.zip_with("u", "x", lambda a, b: a * b))).alias("i", "v"))


def sequency_transform(points: DataFrame, width: int) -> DataFrame:
    """(id, i, v): the transform in the order of sign changes, divided by the length 2**width."""
    order = F.transform(F.sequence(F.lit(0), F.lit((1 << width) - 1)), lambda i: sequency(i.cast("long"), width).cast("int"))
    made = points.select("id", walsh_hadamard(F.col("x")).alias("y")).select("id", "y", F.posexplode(order).alias("i", "natural"))
    return made.select("id", "i", (F.get("y", F.col("natural")) / float(1 << width)).alias("v"))


def gray_codes(spark: SparkSession, width: int) -> DataFrame:
    codes = spark.range(1 << width)
    return codes.select(F.col("id").alias("i"), gray(F.col("id")).alias("code"), bits(gray(F.col("id")), width).alias("bits"))


def butterfly(spark: SparkSession, n: int) -> DataFrame:
    """(i, j, v): the sparse factor F with Hadamard(n) = F^log2(n). Two entries a row.

    Row i < n/2 adds entries 2i and 2i+1, row i + n/2 subtracts them.
    """
    half = n // 2
    row = spark.range(n).select(F.col("id").alias("i"), (F.col("id") % half).alias("p"), F.when(F.col("id") < half, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("s"))
    return row.select("i", F.posexplode(F.array((F.col("p") * 2), (F.col("p") * 2 + 1))).alias("pos", "j"), "s").select(
        "i", "j", F.when(F.col("pos") == 1, F.col("s")).otherwise(F.lit(1.0)).alias("v")
    )


def structured_landmarks(seeds: DataFrame) -> DataFrame:
    """(id, i, x): for each seed vector the rows of Hadamard * diag(seed): as many landmarks as dimensions."""
    n = F.size("x")
    rows = seeds.select("id", "x", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return rows.select("id", "i", F.transform("x", lambda v, j: v * hadamard_sign(F.col("i").cast("long"), j.cast("long"))).alias("x"))


def random_factors(spark: SparkSession, n: int, n_factors: int, sparsity: int, seed: int = 0) -> DataFrame:
    """(q, i, j, v): square factors whose non-zeros are a band of ``sparsity`` values, rows and columns permuted.

    A band at (r, r..r+sparsity-1 mod n), r and columns sent through affine permutations; values are normal
    numbers from a hash of seed and place, whatever the partitions.
    """
    step = next(s for s in range(n // 2 + 1, 2 * n + 2) if np.gcd(s, n) == 1)
    base = spark.range(n_factors * n * sparsity)
    q, r, b = (F.floor(F.col("id") / (n * sparsity)), F.floor(F.col("id") / sparsity) % n, F.col("id") % sparsity)
    permuted = lambda c, shift: ((c * step + shift) % n).cast("int")
    return base.select(q.cast("int").alias("q"), permuted(r, q * 3 + seed).alias("i"), permuted((r + b) % n, q * 5 + seed + 1).alias("j"), gaussian_value(seed, F.col("id")).alias("v"))


def cost_model(n: Column, k: Column, d: Column, sparsity: Column) -> tuple[Column, Column]:
    """Operations of an assignment: with dense centroids NKD + ND, and with a chain of log2(min) factors."""
    a, b = F.least(k, d).cast("double"), F.greatest(k, d).cast("double")
    dense = n * k * d + n * d
    chain = n * (sparsity * (a * F.log2(a) + b)) + a * b + n * d
    return dense.cast("double"), chain


class Sparse:
    """A matrix by its non-zeros in the order of rows."""

    def __init__(self, shape: tuple[int, int], i: np.ndarray, j: np.ndarray, v: np.ndarray):
        order = np.lexsort((j, i))
        self.shape, self.i, self.j, self.v = shape, i[order], j[order], v[order]
        self.starts = np.flatnonzero(np.diff(self.i, prepend=-1))

    @classmethod
    def of(cls, m: np.ndarray) -> Sparse:
        i, j = np.nonzero(m)
        return cls(m.shape, i, j, m[i, j])

    @property
    def T(self) -> Sparse:  # noqa: N802
        return Sparse(self.shape[::-1], self.j, self.i, self.v)

    def conj(self) -> Sparse:
        return Sparse(self.shape, self.i, self.j, self.v.conj())

    def copy(self) -> np.ndarray:
        return self.dense()

    def dense(self) -> np.ndarray:
        out = np.zeros(self.shape, self.v.dtype)
        out[self.i, self.j] = self.v
        return out

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        """Times a vector or a matrix, columns in parts so that the products of a part stay small."""
        wide = x if x.ndim == 2 else x[:, None]
        out = np.zeros((self.shape[0], wide.shape[1]), np.result_type(self.v, x))
        width = max(1, 4_000_000 // max(1, len(self.v)))
        for at in range(0, wide.shape[1] if len(self.v) else 0, width):
            part = wide[:, at : at + width]
            out[self.i[self.starts], at : at + width] = np.add.reduceat(self.v[:, None] * part[self.j], self.starts, axis=0)
        return out if x.ndim == 2 else out[:, 0]


class Chain:
    """A product of matrices on the driver, dense or ``Sparse``. Without factors it is the identity of ``size``."""

    def __init__(self, factors: list[np.ndarray | Sparse], size: int = 0):
        self.factors, self.size = [f if isinstance(f, Sparse) else np.asarray(f) for f in factors], size
        for a, b in zip(self.factors, self.factors[1:]):
            if a.shape[1] != b.shape[0]:
                raise ValueError(f"factors of shapes {a.shape} and {b.shape} have no product")

    def __len__(self) -> int:
        return len(self.factors)

    def __getitem__(self, q: int) -> np.ndarray:
        return self.factors[q].copy()

    def replaced(self, q: int, value: np.ndarray) -> Chain:
        return Chain([*self.factors[:q], value, *self.factors[q + 1 :]])

    def sparse(self) -> Chain:
        """The same with factors by their non-zeros: what is kept and applied has the size of these."""
        return Chain([f if isinstance(f, Sparse) else Sparse.of(f) for f in self.factors], self.size)

    @property
    def shape(self) -> tuple[int, int]:
        return (self.factors[0].shape[0], self.factors[-1].shape[1]) if self.factors else (self.size, self.size)

    def product(self) -> np.ndarray:
        if not self.factors:
            return np.eye(self.size)
        last = self.factors[-1]
        return reduce(lambda done, f: f @ done, reversed(self.factors[:-1]), last.dense() if isinstance(last, Sparse) else last)

    def dot(self, x: np.ndarray) -> np.ndarray:
        """The chain times a vector or matrix, from the right."""
        return reduce(lambda done, f: f @ done, reversed(self.factors), x)

    def adjoint(self) -> Chain:
        return Chain([f.conj().T for f in reversed(self.factors)], self.size)

    def transpose(self) -> Chain:
        return Chain([f.T for f in reversed(self.factors)], self.size)

    def left(self, n: int) -> Chain:
        """The first n factors; none of them are the identity of the chain's height."""
        return Chain(self.factors[:n], self.shape[0])

    def right(self, n: int) -> Chain:
        """The last n factors; none of them are the identity of the chain's width."""
        return Chain(self.factors[len(self) - n :] if n >= 0 else self.factors[-n:], self.shape[1])

    def norm(self) -> float:
        return spectral_norm(self.product())[0] if self.factors else 1.0

    def non_zeros(self) -> int:
        return int(sum(np.count_nonzero(f.v if isinstance(f, Sparse) else f) for f in self.factors))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(q, int(i), int(j), float(v)) for q, f in enumerate(self.sparse().factors) for i, j, v in zip(f.i, f.j, f.v)]
        return spark.createDataFrame(rows, "q int, i int, j int, v double")


def spectral_norm(m: np.ndarray, start: np.ndarray | None = None, rounds: int = 60, tolerance: float = 1e-7) -> tuple[float, np.ndarray]:
    """Largest singular value by power iteration on the smaller side, and the vector to start from next time.

    If it has not settled, the value comes from a full decomposition: it is a step size's bound, so it must
    not be too small.
    """
    small = m if m.shape[0] <= m.shape[1] else m.T
    v = start if start is not None and len(start) == small.shape[0] else np.ones(small.shape[0]) / np.sqrt(small.shape[0])
    before = 0.0
    for _ in range(rounds):
        w = small @ (small.T @ v)
        size = np.linalg.norm(w)
        if size == 0:
            break
        v = w / size
        if abs(size - before) <= tolerance * size:
            return float(np.sqrt(size)), v
        before = size
    return float(np.linalg.norm(m, 2)), v
