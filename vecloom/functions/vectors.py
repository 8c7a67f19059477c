"""Column expressions over vectors (array<double>) and small integer transforms. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sq_norm(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)


def sq_dist(a: Column, b: Column) -> Column:
    """Sum of squared differences: unlike the expanded form it never cancels below zero."""
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l1_norm(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + F.abs(v))


def l1_ball(x: Column, radius: float, slack: float = 0.0) -> Column:
    """Euclidean projection onto the L1 ball; vectors within radius + slack stay as they are.

    The threshold t solves sum(max(|v| - t, 0)) = radius: over magnitudes in descending order it is the
    largest (prefix sum - radius) / prefix length, so one pass over the sorted magnitudes finds it.
    """
    magnitudes = F.sort_array(F.transform(x, lambda v: F.abs(v)), asc=False)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n"), F.lit(0.0).alias("t"))

    def step(a: Column, m: Column) -> Column:
        s, n = a["s"] + m, a["n"] + 1.0
        return F.struct(s.alias("s"), n.alias("n"), F.greatest(a["t"], (s - F.lit(float(radius))) / n).alias("t"))

    cut = F.aggregate(magnitudes, start, step, lambda a: a["t"])
    # a one-element array is a let: the threshold is computed once a row
    shrunk = F.element_at(F.transform(F.array(cut), lambda t: F.transform(x, lambda v: F.signum(v) * F.greatest(F.abs(v) - t, F.lit(0.0)))), 1)
    return F.when(l1_norm(x) <= radius + slack, x).otherwise(shrunk)


def pad_pow2(x: Column) -> Column:
    """Zeros appended up to the next power of two; an empty vector stays empty."""
    n = F.size(x)
    padded = F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("int")
    return F.when(n > 0, F.concat(x, F.array_repeat(F.lit(0.0), padded - n))).otherwise(x)


def hadamard_sign(i: Column, j: Column) -> Column:
    """Entry (i, j) of the natural-order Hadamard matrix."""
    return F.when(F.bit_count(i.bitwiseAND(j)) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def walsh_hadamard(x: Column) -> Column:
    """The unnormalised transform of a vector whose length is a power of two, natural order: log2(n) stages of sums and differences."""

    def stage(a: Column, s: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), s)
        return F.transform(a, lambda v, i: F.when(i.bitwiseAND(step) == 0, v + F.get(a, i + step)).otherwise(F.get(a, i - step) - v))

    stages = F.sequence(F.lit(0), F.log2(F.size(x).cast("double")).cast("int") - 1)
    whole = x.cast("array<double>")
    return F.when(F.size(x) < 2, whole).otherwise(F.aggregate(stages, whole, stage))


def gray(i: Column) -> Column:
    """The i-th reflected Gray code, as a number."""
    return i.bitwiseXOR(F.shiftright(i, 1))


def bits(i: Column, width: int) -> Column:
    return F.lpad(F.bin(i.cast("long")), width, "0")


def sequency(i: Column, width: int) -> Column:
    """Which natural-order row is i-th by number of sign changes: the bit-reversed Gray code."""
    return F.conv(F.reverse(bits(gray(i), width)), 2, 10).cast("long")


def log2_floor(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")
