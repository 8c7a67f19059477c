"""Feature preparation: scaling, encoding, splitting and synthetic points. Statistics are aggregates, rows stay put."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.operators.lloyd import gaussian_value, uniform
from vecloom.operators.positions import with_position


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column scaled to 0..1; columns of one value are dropped (they would be 0/0)."""
    aggregates = [f(c).alias(f"{c}_{name}") for c in columns for f, name in ((F.min, "min"), (F.max, "max"))]
    row = df.agg(*aggregates).first()  # one row
    kept = [c for c in columns if row[f"{c}_min"] is not None and row[f"{c}_min"] != row[f"{c}_max"]]
    scaled = {c: (F.col(c) - F.lit(row[f"{c}_min"])) / F.lit(row[f"{c}_max"] - row[f"{c}_min"]) for c in kept}
    return df.withColumns(scaled).drop(*[c for c in columns if c not in kept])


def one_hot(df: DataFrame, column: str, values: list) -> DataFrame:
    """A 0/1 column for each of the values, in the place of ``column``."""
    flags = {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values}
    return df.withColumns(flags).drop(column)


def categories(df: DataFrame, column: str, most: int = 1000) -> list:
    """The distinct values in order; an error if there are more than ``most`` (one-hot columns have to stay few)."""
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(values)


def label_encode(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Consecutive numbers in the order of the distinct values; only those are ranked, in ranges, then joined back."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    codes = with_position(values, column, name).withColumn(name, F.col(name).cast("int"))
    return df.join(codes, column, "left")


def multi_hot(df: DataFrame, key: str, item: str, values: list) -> DataFrame:
    """One row a key with the number of distinct occurrences (0/1) of each value."""
    return df.groupBy(key).agg(*[F.coalesce(F.max((F.col(item) == v).cast("int")), F.lit(0)).alias(f"has_{v}") for v in values])


def split_multi_hot(lines: DataFrame, column: str, values: list, sep: str = ",") -> DataFrame:
    """Ragged separated attributes to 0/1 columns: first field is the key."""
    parts = F.split(F.trim(column), sep)
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return lines.select(parts[0].alias("key"), *[F.array_contains(rest, str(v)).cast("int").alias(f"has_{v}") for v in values])


def mean_center(points: DataFrame, with_std: bool = False) -> DataFrame:
    """(id, x) less the mean of all points; with_std divides by the population deviation where it isn't 0."""
    stats = points.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    mean = F.array(*[F.lit(r["m"]) for r in stats])  # d rows
    moved = F.zip_with("x", mean, lambda v, m: v - m)
    if with_std:
        moved = F.zip_with(moved, F.array(*[F.lit(r["s"] or 1.0) for r in stats]), lambda v, s: v / s)
    return points.withColumn("x", moved)


def tail_split(df: DataFrame, key: str, n_test: int) -> DataFrame:
    """A column ``split``: the last ``n_test`` rows by key are test. Keys are unique; they alone are ranked."""
    last = df.select(key).orderBy(F.col(key).desc()).limit(n_test).agg(F.min(key).alias("_from"))
    start = last.first()["_from"]  # one row
    return df.withColumn("split", F.when(F.col(key) >= F.lit(start), "test").otherwise("train") if start is not None else F.lit("train"))


def hash_split(df: DataFrame, key: str, test_share: float, seed: int = 0) -> DataFrame:
    """The same by a hash of the key: near the share, without a pass over the rows, equal in every run."""
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30))
    return df.withColumn("split", F.when(draw < int(test_share * (1 << 30)), "test").otherwise("train"))


def stratified_split(df: DataFrame, key: str, label: str, test_share: float) -> DataFrame:
    """In every class the floor(share * n) rows of smallest md5(key) are test.

    A class is ranked in 4,096 ranges of the digest, each in a task of its own; the ranges' counts give the rest.
    """
    digest = F.md5(F.col(key).cast("string").cast("binary"))
    rows = df.withColumn("_digest", digest).withColumn("_range", F.substring("_digest", 1, 3))
    counts = rows.groupBy(label, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(label).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(label, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(label)).alias("_size"))
    inside = F.row_number().over(Window.partitionBy(label, "_range").orderBy("_digest", key))
    ranked = rows.withColumn("_inside", inside).alias("r").join(offsets.alias("o"), F.col(f"r.{label}").eqNullSafe(F.col(f"o.{label}")) & (F.col("r._range") == F.col("o._range")))
    chosen = F.when(F.col("_before") + F.col("_inside") <= F.floor(F.col("_size") * test_share), "test").otherwise("train")
    return ranked.select(*[F.col(f"r.{c}") for c in df.columns], chosen.alias("split"))


def blobs(spark: SparkSession, n: int, d: int, centers: int, std: float = 1.0, seed: int = 0) -> DataFrame:
    """(id, x, label): Gaussian points around centres uniform in -10..10; every value is a function of id and seed."""
    label = F.pmod("id", F.lit(centers)).cast("int")

    def value(i: Column) -> Column:
        return uniform(seed, "c", F.col("label"), i) * 20.0 - 10.0 + gaussian_value(seed, F.col("id"), i) * std

    return spark.range(n).withColumn("label", label).select("id", F.transform(F.sequence(F.lit(1), F.lit(d)), value).alias("x"), "label")


def batches(df: DataFrame, key: str, size: int, keep_last: bool = True) -> DataFrame:
    """A column ``batch``: consecutive rows by key, ``size`` each; without keep_last the rest is left out."""
    placed = with_position(df, key).withColumn("batch", F.floor(F.col("pos") / size))
    return placed if keep_last else placed.filter(F.col("batch") < df.count() // size)
