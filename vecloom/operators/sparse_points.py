"""Wide categorical data as sparse vectors: (id, indices, values) and a vocabulary table.

A dense one-hot needs a column a value; here a value is a row of the vocabulary and a 1 in the vectors that have it, so a
column may have any number of values. Norms and products with dense centroids touch the non-zeros only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.durable import broadcast_if_small, materialize
from vecloom.operators.dense import MAX_CENTROID_VALUES
from vecloom.operators.positions import with_position
from vecloom.shipping import ship

#: Vocabularies of so many values go to every executor.
MAX_BROADCAST_VALUES = 1_000_000
#: Cells of a batch's products with all centroids that are in memory at a time.
CELLS = 4_000_000


def items(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(id, field, value): the categories of rows as text; a null is no category."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    rows = df.select(F.col(key).alias("id"), F.explode(pairs).alias("item"))
    return rows.select("id", "item.field", "item.value").filter("value IS NOT NULL")


def listed_items(df: DataFrame, key: str, column: str, sep: str = ",", field: str = "item") -> DataFrame:
    """(id, field, value) of a column of separated attributes; blank ones are none."""
    parts = F.explode(F.split(column, sep))
    return df.select(F.col(key).alias("id"), F.lit(field).alias("field"), parts.alias("value")).withColumn("value", F.trim("value")).filter("value <> ''")


def vocabulary(found: DataFrame) -> DataFrame:
    """(field, value, index): consecutive numbers in the order of field and value, ranked in ranges."""
    distinct = found.select("field", "value").distinct().withColumn("order", F.struct("field", "value"))
    return materialize(with_position(distinct, "order", "index").select("field", "value", F.col("index").cast("int").alias("index")), "vocabulary")


def vectors(found: DataFrame, words: DataFrame, counts: bool = False) -> DataFrame:
    """(id, indices, values): one sparse vector an id, indices ascending; values are 1, or with ``counts`` how often. Unknown values are left out.

    Items are counted before they are gathered, so repeated ones don't move; a vector is as long as its id has values.
    """
    coded = found.join(broadcast_if_small(words, MAX_BROADCAST_VALUES), ["field", "value"]).groupBy("id", "index").agg(F.count(F.lit(1)).cast("double").alias("n"))
    entry = F.struct("index", (F.col("n") if counts else F.lit(1.0)).alias("v"))
    rows = coded.groupBy("id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    return rows.select("id", F.transform("entries", lambda e: e["index"]).alias("indices"), F.transform("entries", lambda e: e["v"]).alias("values"))


def one_hot(df: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sparse one-hot vectors of rows, and their vocabulary; keys are unique."""
    found = items(df, key, columns)
    words = vocabulary(found)
    return vectors(found, words), words


def sq_norm(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v * v)


def dense(points: DataFrame, d: int) -> DataFrame:
    """(id, x) of d values each: for narrow vocabularies."""
    at = F.map_from_arrays("indices", "values")
    return points.select("id", F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.coalesce(F.try_element_at(at, i), F.lit(0.0))).alias("x"))


def assign(points: DataFrame, centroids: np.ndarray, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """``keep`` columns, k and d2 of each sparse point with its nearest dense centroid, the lowest k of ties within rounding.

    |x|^2 - 2 x.u + |u|^2 with products over the non-zeros: a batch of points is a sparse matrix times the centroids.
    """
    centroids = np.asarray(centroids, np.float64)
    if centroids.size > MAX_CENTROID_VALUES:
        raise ValueError("too many centroids to send to every executor")
    ship(points.sparkSession)
    held = points.sparkSession.sparkContext.broadcast(np.ascontiguousarray(centroids.T))
    schema = ", ".join(f"{n} {t}" for n, t in points.select(*keep).dtypes) + ", k int, d2 double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = held.value
        norms = (u * u).sum(axis=0)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                indices, values = part.column("indices"), part.column("values")
                i, v = indices.flatten().to_numpy(), values.flatten().to_numpy()
                size = np.diff(indices.offsets.to_numpy())
                dots, begins = np.zeros((part.num_rows, u.shape[1])), np.concatenate([[0], np.cumsum(size)])
                step = max(1, CELLS // u.shape[1])
                for row in range(part.num_rows):
                    for start in range(begins[row], begins[row + 1], step):
                        end = min(start + step, begins[row + 1])
                        dots[row] += v[start:end] @ u[i[start:end]]
                own = np.add.reduceat(np.append(v * v, 0.0), begins[:-1]) * (size > 0)
                d2 = own[:, None] - 2 * dots + norms
                k = (d2 <= d2.min(axis=1, keepdims=True) + 1e-9 * (1 + norms.max(initial=0))).argmax(axis=1)
                best = np.maximum(d2[np.arange(len(k)), k], 0.0)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(k.astype(np.int32)), pa.array(best)], names=[*keep, "k", "d2"])

    return points.select(*dict.fromkeys([*keep, "indices", "values"])).mapInArrow(run, schema)


def means(points: DataFrame, assigned: DataFrame) -> DataFrame:
    """(k, index, value): the non-zero coordinates of the clusters' means."""
    placed = points.join(assigned.select("id", "k"), "id")
    sizes = assigned.groupBy("k").agg(F.count(F.lit(1)).alias("n"))  # K rows
    sums = placed.select("k", F.explode(F.arrays_zip("indices", "values")).alias("e")).groupBy("k", F.col("e.indices").alias("index")).agg(F.sum("e.values").alias("s"))
    return sums.join(F.broadcast(sizes), "k").select("k", "index", (F.col("s") / F.col("n")).alias("value"))
