"""Clustering of a stream: every micro-batch moves the running means of its points' clusters.

The state is K x d numbers. With a folder it is written there, batch by batch, before the engine commits the
batch: a query that starts again from its checkpoint goes on from the state of the last batch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vecloom.durable import drop
from vecloom.operators.dense import pass_over


@dataclass
class RunningMeans:
    """State of K x d numbers on the driver; counts persist, so later batches weigh less."""

    centroids: np.ndarray
    counts: np.ndarray
    #: the objective of each batch under the centroids before it; with ``everything``, of all points after it
    trace: list[float] = field(default_factory=list)
    everything: DataFrame | None = None
    last_batch: int = -1
    #: where the state is kept between runs
    folder: str | None = None

    @classmethod
    def start(cls, centroids: np.ndarray, everything: DataFrame | None = None) -> RunningMeans:
        return cls(np.array(centroids, np.float64), np.zeros(len(centroids), np.int64), everything=everything)

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """One batch of (id, x). A batch that is replayed after a failure changes nothing."""
        if batch_id <= self.last_batch:
            return
        got = pass_over(batch, self.centroids)
        total = self.counts + got.counts
        moved = (self.counts[:, None] * self.centroids + got.sums) / np.maximum(total, 1)[:, None]
        self.centroids = np.where(got.counts[:, None] > 0, moved, self.centroids)
        self.counts, self.last_batch = total, batch_id
        if self.everything is not None:
            got = pass_over(self.everything, self.centroids)
        self.trace.append(float(got.objective.sum()))
        if self.folder:
            self._save(batch.sparkSession)

    def _save(self, spark: SparkSession) -> None:
        """A table (k, n, u) for each batch; that before the last is kept, as the last may be half written."""
        rows = [(k, int(n), [float(v) for v in u]) for k, (n, u) in enumerate(zip(self.counts, self.centroids))]
        spark.createDataFrame(rows, "k int, n long, u array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/means-{self.last_batch}")
        drop(spark, f"{self.folder}/means-{self.last_batch - 2}")

    def resume(self, spark: SparkSession, folder: str) -> None:
        """Keeps the state in ``folder`` from now on, and takes the last one that is whole there, if any."""
        self.folder = folder
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []
        for batch in sorted((int(n.removeprefix("means-")) for n in names if n.startswith("means-")), reverse=True):
            if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/means-{batch}/_SUCCESS")):
                rows = spark.read.parquet(f"{folder}/means-{batch}").orderBy("k").collect()  # K rows
                self.counts, self.centroids = np.array([r["n"] for r in rows], np.int64), np.array([r["u"] for r in rows], np.float64)
                self.last_batch = batch
                return


def cluster_stream(points: DataFrame, state: RunningMeans, checkpoint: str) -> StreamingQuery:
    """Starts the query over all available input; ``state`` holds the result once it has stopped. It is kept beside the checkpoint."""
    state.resume(points.sparkSession, f"{checkpoint}-state")
    return points.writeStream.foreachBatch(state.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
