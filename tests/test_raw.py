from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import dense, kernels, lloyd
from vecloom.sources.raw import read_raw, write_raw
from vecloom.sources.tables import first_rows, points


@pytest.mark.parametrize("dtype", ["<f4", "<f8", ">i2"])
def test_many_tasks_a_file(spark, tmp_path, dtype):
    x = np.arange(300).reshape(100, 3)
    (tmp_path / "a.bin").write_bytes(x.astype(dtype).tobytes())
    got = read_raw(spark, str(tmp_path / "a.bin"), 3, dtype, part_bytes=3 * np.dtype(dtype).itemsize * 7)
    assert got.rdd.getNumPartitions() == 15
    rows = sorted((r["row"], r["x"]) for r in got.collect())
    assert [r for r, _ in rows] == list(range(100)) and np.array_equal([v for _, v in rows], x)


def test_round_trip(spark, tmp_path):
    """A file a task; an empty task writes none; a folder is not written into twice."""
    df = spark.range(50).select("id", F.array(F.col("id") * 0.5, F.lit(-1.0)).alias("x")).repartition(3, "id").filter("id < 40")
    path = f"file://{tmp_path}/out"
    write_raw(df, path, 2)
    again = read_raw(spark, path, 2, part_bytes=64)
    assert sorted(r["x"][0] for r in again.collect()) == [i * 0.5 for i in range(40)]
    assert again.select("path").distinct().count() <= 3
    with pytest.raises(Exception, match="out"):
        write_raw(df, path, 2)


def test_wrong_sizes(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"12345")
    with pytest.raises(Exception, match="records"):
        read_raw(spark, str(tmp_path / "a.bin"), 3).count()
    with pytest.raises(Exception):
        write_raw(spark.range(3).select(F.array(F.lit(1.0)).alias("x")), f"{tmp_path}/b", 2)
    with pytest.raises(Exception):
        read_raw(spark, str(tmp_path / "none.bin"), 3).count()


def test_batches(spark, sf_dir):
    """Batches of a table add up to the pass; the last is short; a step reads its folder only."""
    pts = points(spark, sf_dir).filter("id < 230")
    batches = lloyd.batched(pts, "id", 100)
    assert batches.count == 3 and [batches.batch(b).count() for b in range(3)] == [100, 100, 30]
    assert sorted(r["id"] for r in batches.batch(1).collect()) == list(range(100, 200))
    plan = batches.batch(1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan and "(batch" in plan.split("PartitionFilters")[1]
    u = first_rows(pts, 6)
    whole, parts = dense.pass_over(pts, u), lloyd.batch_pass(batches, u)
    assert np.array_equal(whole.counts, parts.counts) and np.allclose(whole.sums, parts.sums) and np.allclose(whole.objective, parts.objective)
    a, b = lloyd.minibatch_kmeans(pts, u, 3), lloyd.minibatch_kmeans(pts, u, 3, batch_size=100)
    assert np.allclose(a.centroids, b.centroids) and np.allclose(a.trace, b.trace)
    with pytest.raises(ValueError):
        lloyd.batched(pts, "id", 0)


@pytest.mark.parametrize("rows", [2048, 37])
def test_kernel_error_is_exact(spark, monkeypatch, rows):
    """Over all pairs, in one block or many, in slices or at once."""
    if rows < 100:
        monkeypatch.setattr(kernels, "CELLS", 37 * 5)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    model = kernels.Nystrom(x[:6], 0.4)
    k, z = kernels.rbf_matrix(x, x, 0.4), model.embed(x)
    assert np.isclose(kernels.kernel_error(df, model, rows), np.linalg.norm(z @ z.T - k) / np.linalg.norm(k), rtol=1e-9)
    assert kernels.kernel_error(df.filter("false"), model) == 0.0
