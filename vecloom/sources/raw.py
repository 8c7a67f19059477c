"""Headerless row-major matrices of numbers, read and written by parts.

A record is ``d`` numbers of one type, so any range of whole records can be read alone: a file of any size is many tasks,
none of which holds more than a few records. Paths may be of any file system that pyarrow knows (file, hdfs, s3, gs).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from vecloom.shipping import ship

#: Bytes of a part, and records of an Arrow batch.
PART_BYTES, RECORDS = 64 << 20, 4096


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


@dataclass
class Part(InputPartition):
    path: str
    first: int
    records: int


@dataclass
class Written(WriterCommitMessage):
    path: str
    records: int


class RawMatrix(DataSource):
    """Options: path, d, dtype (numpy's, little-endian floats of 4 bytes by default), partBytes. A path may be a file or a folder of .bin files."""

    @classmethod
    def name(cls) -> str:
        return "raw_matrix"

    def schema(self) -> str:
        return "path string, row long, x array<double>"

    def reader(self, schema) -> DataSourceReader:
        return RawReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return RawWriter(self.options, overwrite)


class RawReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.d, self.dtype = options["path"], int(options["d"]), options.get("dtype", "<f4")
        self.part_bytes = int(options.get("partBytes", PART_BYTES))

    def partitions(self) -> list[Part]:
        system, path = _at(self.path)
        info = system.get_file_info(path)
        files = [info]
        if info.type == fs.FileType.Directory:
            files = [f for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name.endswith(".bin")]
        elif info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        width, out = self.d * np.dtype(self.dtype).itemsize, []
        for f in sorted(files, key=lambda f: f.path):
            if f.size % width:
                raise ValueError(f"{f.path}: {f.size} bytes are not records of {width}")
            step = max(1, self.part_bytes // width)
            out += [Part(f.path, at, min(step, f.size // width - at)) for at in range(0, f.size // width, step)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, _ = _at(self.path)
        width = self.d * np.dtype(self.dtype).itemsize
        with system.open_input_file(part.path) as f:
            f.seek(part.first * width)
            for at in range(0, part.records, RECORDS):
                n = min(RECORDS, part.records - at)
                x = np.frombuffer(f.read(n * width), self.dtype).astype(np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * self.d + 1, self.d, dtype=np.int32)), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array(np.arange(part.first + at, part.first + at + n)), lists], names=["path", "row", "x"])


class RawWriter(DataSourceArrowWriter):
    """One file a task, of the column x; a task that is run again replaces its file, what a failed job leaves is deleted."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.d, self.dtype, self.overwrite = options["path"], int(options["d"]), options.get("dtype", "<f4"), overwrite
        system, path = _at(self.path)
        there = system.get_file_info(path).type == fs.FileType.Directory
        if there and not overwrite and system.get_file_info(fs.FileSelector(path)):
            raise FileExistsError(self.path)
        system.create_dir(path, recursive=True)
        self.old = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.is_file] if there and overwrite else []

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, path = _at(self.path)
        context = TaskContext.get()
        name = f"{path}/part-{context.partitionId():05d}-{context.taskAttemptId()}.bin"
        n = 0
        with system.open_output_stream(name) as out:
            for batch in batches:
                column = batch.column("x")
                if batch.num_rows and (np.diff(column.offsets.to_numpy()) != self.d).any():
                    raise ValueError(f"vectors that are not of {self.d} values")
                out.write(column.flatten().to_numpy(zero_copy_only=False).astype(self.dtype).tobytes())
                n += batch.num_rows
        if not n:
            system.delete_file(name)
        return Written(name if n else "", n)

    def commit(self, messages: list[Written]) -> None:
        system, path = _at(self.path)
        kept = {m.path for m in messages if m is not None}
        for f in system.get_file_info(fs.FileSelector(path)):
            if f.is_file and (f.path in self.old or f.base_name.startswith("part-") and f.path not in kept):
                system.delete_file(f.path)

    def abort(self, messages: list[Written]) -> None:
        system, _ = _at(self.path)
        for m in messages:
            if m is not None and m.path and system.get_file_info(m.path).is_file:
                system.delete_file(m.path)


def read_raw(spark: SparkSession, path: str, d: int, dtype: str = "<f4", part_bytes: int = PART_BYTES) -> DataFrame:
    """(path, row, x): row is a record's number in its file."""
    ship(spark)
    spark.dataSource.register(RawMatrix)
    return spark.read.format("raw_matrix").option("d", d).option("dtype", dtype).option("partBytes", part_bytes).load(path)


def write_raw(points: DataFrame, path: str, d: int, dtype: str = "<f4") -> None:
    """The vectors of ``points`` (x) as records, a file a task, in the order of each task's rows."""
    ship(points.sparkSession)
    points.sparkSession.dataSource.register(RawMatrix)
    points.select("x").write.format("raw_matrix").option("d", d).option("dtype", dtype).mode("append").save(path)
