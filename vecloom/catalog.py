"""All queries of the library itself, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.plans import algebra, clustering, evaluation, relational  # noqa: F401  they register their queries
from vecloom.plans.registry import ORACLES, QUERIES, Query
from vecloom.sources.tables import first_rows, points


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-means on the embeddings: members and squared distances of each cluster."""
    from vecloom.operators.lloyd import kmeans

    pts = points(spark, sf_dir)
    placed = kmeans(pts, first_rows(pts, 8), max_iter=5).transform(pts)
    return placed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d2"), 6).alias("objective"))
