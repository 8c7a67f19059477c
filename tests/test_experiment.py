from __future__ import annotations

import pytest

from vecloom import experiment
from vecloom.operators.prepare import blobs
from vecloom.sources.tables import read_centroids


@pytest.mark.parametrize("model", experiment.MODELS)
def test_models(spark, model):
    pts = blobs(spark, 200, 8, 4, seed=1)
    got = experiment.run(pts, experiment.Options(model=model, k=4, init="kmeans++", test=20, nn=True, ami=True, nystrom=100, timing=20, max_iter=5, sparsity=4))
    record = got.record
    assert not record["failure"], record
    assert record["nn_accuracy"] > 0.8 and record["nystrom_error"] < 1 and record["assign_n"] >= 20
    if "factorized" not in model:
        assert record["ami"] > 0.8


def test_failure_is_a_record(spark):
    got = experiment.run(blobs(spark, 10, 2, 2), experiment.Options(empty="error", init="gaussian", k=9, center=False))
    assert got.record["failure"] and "empty" in got.record["reason"]
    with pytest.raises(ValueError):
        experiment.run(blobs(spark, 10, 2, 2), experiment.Options(model="other"))


def test_command_line(spark, tmp_path):
    blobs(spark, 60, 4, 3, seed=1).write.parquet(str(tmp_path / "p"))
    experiment.main(["--points", str(tmp_path / "p"), "--out", str(tmp_path / "o"), "--k", "3", "--no-center", "--init", "first"])
    assert read_centroids(spark, str(tmp_path / "o" / "centroids")).shape == (3, 4)
    row = spark.read.option("header", True).csv(str(tmp_path / "o" / "record")).first()
    assert row["failure"] == "False" and row["k"] == "3" and row["l1_radius"] == "None"
