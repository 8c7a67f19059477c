"""Projections of a matrix (i, j, v) onto sparse ones, as window queries and for driver arrays.

Ties in magnitude go to the lower column-major place. Rank filters become group limits before the shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _size(v: Column) -> Column:
    return F.abs(F.round(v, 10))


def top_n(matrix: DataFrame, n: int) -> DataFrame:
    """The n entries of largest magnitude in the whole matrix."""
    return matrix.orderBy(_size(F.col("v")).desc(), "j", "i").limit(n)


def top_k_per_column(matrix: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("j").orderBy(_size(F.col("v")).desc(), "i"))
    return matrix.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def top_k_per_row(matrix: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("i").orderBy(_size(F.col("v")).desc(), "j"))
    return matrix.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def budget(rows: int, cols: int, total: int) -> tuple[int, int]:
    """Entries for each column and for each row of a total for the whole matrix."""
    return rows * total // (rows * cols), cols * total // (rows * cols)


def top_rows_and_columns(matrix: DataFrame, rows: int, cols: int, total: int) -> DataFrame:
    """The union of the largest entries of each column and of each row."""
    per_col, per_row = budget(rows, cols, total)
    return top_k_per_column(matrix, per_col).unionByName(top_k_per_row(matrix, per_row)).dropDuplicates(["i", "j"])


def keep_top_n(m: np.ndarray, n: int) -> np.ndarray:
    flat = np.abs(np.round(m, 10)).ravel(order="F")
    mask = np.zeros(m.size, bool)
    mask[np.argsort(-flat, kind="stable")[:n]] = True
    return np.where(mask.reshape(m.shape, order="F"), m, 0.0)


def keep_rows_and_columns(m: np.ndarray, total: int) -> np.ndarray:
    """``top_rows_and_columns`` for an array."""
    per_col, per_row = budget(*m.shape, total)
    size = -np.abs(np.round(m, 10))
    mask = np.zeros(m.shape, bool)
    best = np.argsort(size, axis=0, kind="stable")[:per_col]
    np.put_along_axis(mask, best, True, axis=0)
    best = np.argsort(size, axis=1, kind="stable")[:, :per_row]
    np.put_along_axis(mask, best, True, axis=1)
    return np.where(mask, m, 0.0)
