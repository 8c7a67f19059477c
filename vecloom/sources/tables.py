"""Where points and tables come from and go to."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x array<double>, label): the embeddings, cast once so that all arithmetic is in doubles."""
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


def feature_points(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(id, x) of numeric columns."""
    return df.select(F.col(key).alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))


#: Sets of points by name: of a table the key and the numeric columns, or the vectors that it has already.
DATASETS: dict[str, tuple[str, list[str]] | None] = {
    "embeddings": None,
    "lineitem": ("l_orderkey", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
    "orders": ("o_orderkey", ["o_totalprice"]),
    "customer": ("c_custkey", ["c_acctbal"]),
}


def dataset(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(id, x) of a set by its name."""
    if name not in DATASETS:
        raise ValueError(f"no set {name!r}: one of {sorted(DATASETS)}")
    columns = DATASETS[name]
    return points(spark, sf_dir).select("id", "x") if columns is None else feature_points(load(spark, sf_dir, name), *columns)


def first_rows(points: DataFrame, k: int) -> np.ndarray:
    """The k points of smallest id."""
    return np.array([r["x"] for r in points.orderBy("id").limit(k).select("x").collect()], np.float64)


def read_delimited(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", drop: int = 0) -> DataFrame:
    """Text with a separator, or with runs of white space where sep is None; the first ``drop`` columns are left out."""
    if sep is None:
        parts = F.split(F.trim("value"), r"\s+")
        lines = spark.read.text(path)
        n = lines.select(F.max(F.size(parts))).first()[0] or 0
        rows = lines.select(*[F.get(parts, i).alias(f"_c{i}") for i in range(n)])
    else:
        reader = spark.read.option("sep", sep)
        rows = (reader.schema(schema) if schema else reader).csv(path)
    return rows.drop(*rows.columns[:drop])


def read_raw_matrix(spark: SparkSession, path: str, d: int, dtype: str = "<f4") -> DataFrame:
    """(path, row, x) of headerless row-major files of numbers; a file is read by one task as one value."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                x = np.frombuffer(content, dtype).reshape(-1, d).astype(np.float64)
                for at in range(0, len(x), 4096):
                    part = x[at : at + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(list(part), type=pa.list_(pa.float64()))], names=["path", "row", "x"]
                    )

    return files.mapInArrow(run, "path string, row long, x array<double>")


def write_points(points: DataFrame, path: str) -> None:
    points.write.mode("overwrite").parquet(path)


def write_trace(spark: SparkSession, trace: list[float], path: str) -> None:
    """(iter, objective): an iteration that didn't run has no row."""
    spark.createDataFrame(list(enumerate(map(float, trace))), "iter int, objective double").write.mode("overwrite").parquet(path)


def write_centroids(spark: SparkSession, centroids: np.ndarray, path: str) -> None:
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(centroids)]
    spark.createDataFrame(rows, "k int, u array<double>").write.mode("overwrite").parquet(path)


def read_centroids(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r["u"] for r in spark.read.parquet(path).orderBy("k").collect()], np.float64)


def write_factors(factors: DataFrame, scale: float, path: str) -> None:
    """A chain (q, i, j, v) by its non-zeros, and the scale of its product."""
    factors.select("q", "i", "j", "v", F.lit(float(scale)).alias("scale")).write.mode("overwrite").parquet(path)


def read_factors(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    """The chain and its scale; a chain without non-zeros has scale 0."""
    rows = spark.read.parquet(path)
    first = rows.select("scale").first()
    return rows.drop("scale"), first["scale"] if first else 0.0
