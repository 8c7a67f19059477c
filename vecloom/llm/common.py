"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.shipping import ship

#: What separates words in every contract: space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def typed(df: DataFrame, column: str) -> str:
    """A column's name and type for a schema: ids keep the type that they come with."""
    return f"{column} {df.schema[column].dataType.simpleString()}"


def id_crc(column: str | Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan with fewer partitions than the cluster has cores, dealt evenly to as many; else ``df`` itself.

    So few partitions hold little, and the work on a text costs far more than to move it. Plans with a shuffle
    have their partitions from it and are left alone.
    """
    execution = df._jdf.queryExecution()
    if execution.executedPlan().nodeName().startswith("AdaptiveSparkPlan"):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < execution.toRdd().getNumPartitions() < cores else df


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[dict]], schema: str, rows: int = 256) -> DataFrame:
    """mapInArrow by slices of at most ``rows`` rows, so that Python holds few texts at a time.

    ``function`` gets a slice and returns a dict of columns (lists or arrays) or None.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    if not isinstance(kind, StructType):
        raise ValueError(f"not a row type: {schema}")
    target = to_arrow_schema(kind)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                columns = function(batch.slice(at, rows))
                if columns is not None:
                    arrays = [x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, type=f.type) for f in target]
                    yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return spread(df).mapInArrow(run, kind)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.large_binary()).to_pylist()]


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column as str, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]
