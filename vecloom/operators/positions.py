"""Row positions and prefix sums in a global order, without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.durable import materialize


#: Bits of a row's number within its partition in monotonically increasing ids.
INSIDE = 33


def with_position(df: DataFrame, order: str, name: str = "pos") -> DataFrame:
    """``df`` with its 0-based position by ``order``; rows of equal value stand in any order.

    Whole rows are dealt to ranges and sorted there, once; the numbers in a range and the ranges' counts give the positions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("_row", F.monotonically_increasing_id())
    dealt = materialize(dealt, "ranges").withColumn("_part", F.shiftright("_row", INSIDE))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_offset"))
    # one row a range: bounded by the number of partitions
    inside = F.col("_row").bitwiseAND(F.lit((1 << INSIDE) - 1))
    return dealt.join(F.broadcast(offsets), "_part").select(*df.columns, (inside + F.col("_offset")).alias(name))


def with_prefix_sum(df: DataFrame, order: str, value: str, name: str = "cum") -> DataFrame:
    """(order, value, name): the sum of ``value`` up to and with the row, by ``order`` (unique values).

    Ranges are summed on their own; a table of one row a range gives what comes before each.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(order, value).repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").agg(F.sum(value).alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_inside", inside).join(F.broadcast(offsets), "_part").select(order, value, (F.col("_inside") + F.col("_offset")).alias(name))
