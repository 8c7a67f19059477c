"""Tables that outlive an executor: written through Spark to the cluster's shared folder and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one of our own, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="vecloom-")
        _delete_on_exit(spark, _LOCAL[app])
    return _LOCAL[app]


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _delete_on_exit(spark, path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and read it back: lineage is cut and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._durable_path = path
    return table


def release(table: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for ``table``, when nothing that is still to run reads it. Others are left alone."""
    path = getattr(table, "_durable_path", None)
    if path:
        drop(table.sparkSession, path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint for a materialized table of at most ``max_rows`` rows; beyond that Spark shuffles both sides."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= max_rows else df
