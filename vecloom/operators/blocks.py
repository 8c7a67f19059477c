"""All pairs of points by blocks: points are packed where they stand, and blocks meet by a cartesian product.

A block is one row of the packed table, which is written once. Spark's cartesian product reads both sides again for every pair of
partitions and shuffles nothing, so disk grows with the points and not with their pairs; a task holds one partition and
streams the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.durable import new_path
from vecloom.operators.dense import matrix
from vecloom.shipping import ship

#: Values of a block at most (but for a single point of more): 1 MB of doubles.
BLOCK_VALUES = 131_072

#: A block: its number, points, values of a point, and their bytes; ``x`` is single floats where these are the same numbers.
SCHEMA = "n int, d int, single boolean, x binary"


def packed(points: DataFrame, rows: int, keep: tuple[str, ...] = (), order: tuple[str, ...] = (), tag: str = "blocks") -> DataFrame:
    """Blocks of at most ``rows`` points (x and numbers ``keep``, which become bytes of longs or doubles), numbered by ``block``.

    The points of an Arrow batch stand by ``order`` of the numbers kept.
    """
    ship(points.sparkSession)
    kinds = {name: np.float64 if kind in ("double", "float") else np.int64 for name, kind in points.select(*keep).dtypes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if order:
                batch = batch.sort_by([(c, "ascending") for c in order])
            whole = matrix(batch.column("x"))
            step = max(1, min(rows, BLOCK_VALUES // max(1, whole.shape[1])))
            for at in range(0, batch.num_rows, step):
                x, part = whole[at : at + step], batch.slice(at, step)
                short = x.astype(np.float32)
                single = np.array_equal(short, x)
                held = [np.ascontiguousarray(part.column(c).to_numpy(zero_copy_only=False).astype(kind)).tobytes() for c, kind in kinds.items()]
                columns = [pa.array([len(x)], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([single]), pa.array([(short if single else np.ascontiguousarray(x)).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([h], pa.binary()) for h in held)], names=["n", "d", "single", "x", *keep])

    made = points.select("x", *keep).mapInArrow(run, ", ".join([SCHEMA, *(f"{c} binary" for c in keep)])).withColumn("block", F.monotonically_increasing_id())
    # neither compressed nor by a dictionary: a partition is as large in memory as it is on disk
    path = new_path(points.sparkSession, tag)
    made.write.option("compression", "none").option("parquet.enable.dictionary", "false").option("parquet.block.size", 16 << 20).parquet(path)
    table = points.sparkSession.read.schema(made.schema).parquet(path)
    table._durable_path = path
    return table


def pairs(left: DataFrame, right: DataFrame, condition: Column | None = None) -> DataFrame:
    """Every pair of two packed tables that meets the condition, columns prefixed by a_ and b_; rows of one ``left`` block follow each other."""
    sides = [side.select(*(F.col(c).alias(prefix + c) for c in side.columns)) for side, prefix in ((left, "a_"), (right, "b_"))]
    return sides[0].join(sides[1].hint("shuffle_replicate_nl"), condition if condition is not None else F.lit(True))


def vectors(batch: pa.RecordBatch, row: int, side: str) -> np.ndarray:
    """The points of one side's block as a matrix of doubles."""
    kind = np.float32 if batch.column(side + "single")[row].as_py() else np.float64
    return np.frombuffer(batch.column(side + "x")[row].as_buffer(), kind).astype(np.float64, copy=False).reshape(-1, batch.column(side + "d")[row].as_py())


def numbers(batch: pa.RecordBatch, row: int, column: str, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(batch.column(column)[row].as_buffer(), kind)
