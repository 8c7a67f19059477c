"""One clustering experiment from the command line, or as a function: cluster, evaluate, write one record.

    python -m vecloom.experiment --points points.parquet --out results/run1 --model factorized --k 16 --nn --ami --nystrom 500

Points are a table (id, x array<double>) with an optional label; the last ``--test`` ids are the test set. The record
has a row even if a task fails (failure is then true and says why); it, the trace and the centroids go below --out.
"""

from __future__ import annotations

import argparse
import time
import traceback
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators import evaluate, kernels, lloyd, prepare
from vecloom.operators.chain import Chain
from vecloom.operators.factorized_kmeans import FactorizedKMeansModel, factorized_after_kmeans, factorized_kmeans
from vecloom.operators.report import write_record
from vecloom.sources.tables import write_centroids, write_trace

MODELS = ("kmeans", "minibatch", "kmeans_then_factorized", "factorized")
INITS = ("uniform", "kmeans++", "gaussian", "first")


@dataclass
class Options:
    model: str = "kmeans"
    k: int = 8
    init: str = "uniform"
    seed: int = 0
    max_iter: int = 10
    delta: float = 1e-6
    n_factors: int | None = None
    sparsity: int = 2
    palm_iter: int = 30
    hierarchical: bool = False
    l1_radius: float | None = None
    l1_slack: float = 0.0
    empty: str = "farthest"
    center: bool = True
    test: int = 0
    nn: bool = False
    ami: bool = False
    nystrom: int = 0
    svm: bool = False
    timing: int = 0


@dataclass
class Result:
    centroids: np.ndarray
    trace: list[float]
    record: dict = field(default_factory=dict)


def initial(points: DataFrame, options: Options) -> np.ndarray:
    if options.init == "uniform":
        return lloyd.first_by_hash(points, options.k, options.seed)
    if options.init == "kmeans++":
        return lloyd.plus_plus(points, options.k, options.seed)
    if options.init == "first":
        return np.array([r["x"] for r in points.orderBy("id").limit(options.k).select("x").collect()], np.float64)
    return lloyd.gaussian(points.sparkSession, options.k, len(points.select("x").first()["x"]), options.seed)


def cluster(points: DataFrame, options: Options) -> tuple[np.ndarray, list[float], int]:
    """Centroids, objective trace and number of parameters of the chosen model."""
    u = initial(points, options)
    if options.model == "factorized":
        found = factorized_kmeans(
            points, u, options.n_factors, options.sparsity, options.max_iter, options.delta, options.palm_iter, hierarchical_inside=options.hierarchical, empty=options.empty, seed=options.seed
        )
        return found.centroids, found.trace, found.n_param
    if options.model == "minibatch":
        plain = lloyd.minibatch_kmeans(points, u, options.max_iter, options.delta)
    else:
        plain = lloyd.kmeans(points, u, options.max_iter, options.delta, options.empty, options.l1_radius, options.l1_slack, options.seed)
    trace = [after for _, after in plain.trace]
    if options.model == "kmeans_then_factorized":
        after: FactorizedKMeansModel = factorized_after_kmeans(plain.centroids, options.n_factors, options.sparsity, options.palm_iter)
        return after.centroids, trace, after.n_param
    return plain.centroids, trace, Chain([plain.centroids]).non_zeros()


def run(points: DataFrame, options: Options) -> Result:
    """Clusters the training points and does the tasks that the options and the columns allow."""
    if options.model not in MODELS or options.init not in INITS:
        raise ValueError(f"model is one of {MODELS}, init one of {INITS}")
    spark = points.sparkSession
    points = prepare.tail_split(points, "id", options.test)
    if options.center:
        points = prepare.mean_center(points)
    train, test = points.filter("split = 'train'"), points.filter("split = 'test'")
    record: dict = asdict(options)
    out = Result(np.zeros((0, 0)), [], record)
    try:
        began = time.perf_counter()
        out.centroids, out.trace, record["n_param"] = cluster(train, options)
        record["seconds"] = time.perf_counter() - began
        record["objective"] = out.trace[-1] if out.trace else None
        labelled = "label" in points.columns
        if options.timing:
            record |= {f"assign_{k}": v for k, v in evaluate.timed_assignment(train, out.centroids, options.timing).first().asDict().items()}
        if options.nn and labelled and options.test:
            found = evaluate.one_nn_pruned(train, test, out.centroids).select("id", F.col("label").alias("predicted")).join(test.select("id", "label"), "id")
            record["nn_accuracy"] = found.agg(evaluate.accuracy(F.col("predicted"), F.col("label")).alias("a")).first()["a"]
        if options.ami and labelled:
            table = evaluate.contingency(evaluate.assign(train, out.centroids, keep=("id", "label")))
            record["ami"] = evaluate.adjusted_mutual_information(table).first()["ami"]
        if options.nystrom:
            record["gamma"] = kernels.gamma_heuristic(train).first()["gamma"]
            model = kernels.Nystrom(out.centroids, record["gamma"])
            record["nystrom_error"] = kernels.reconstruction_error(train, model, options.nystrom, options.seed)
            uniform = kernels.Nystrom(lloyd.first_by_hash(train, options.k, options.seed + 1), record["gamma"])
            record["nystrom_error_uniform"] = kernels.reconstruction_error(train, uniform, options.nystrom, options.seed)
            if options.svm and labelled and options.test:
                z = [model.transform(part, keep=("id", "label")) for part in (train, test)]
                record["svm_accuracy"] = evaluate.linear_svm(*z).agg(evaluate.accuracy(F.col("predicted"), F.col("label")).alias("a")).first()["a"]
        record["failure"] = False
    except Exception:  # a failed run is a row of the report, too
        record |= {"failure": True, "reason": traceback.format_exc(limit=1).strip().splitlines()[-1][:200]}
    spark.catalog.clearCache()
    return out


def as_frame(spark: SparkSession, record: dict) -> DataFrame:
    """One row of texts; what is missing is null."""
    names = sorted(record)
    return spark.createDataFrame([tuple(None if record[n] is None else str(record[n]) for n in names)], ", ".join(f"`{n}` string" for n in names))


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--points", required=True)
    parser.add_argument("--out", required=True)
    kinds = {"n_factors": int, "l1_radius": float}
    for name, value in asdict(Options()).items():
        flag = "--" + name.replace("_", "-")
        if isinstance(value, bool):
            parser.add_argument(flag, dest=name, action=argparse.BooleanOptionalAction, default=value)
        else:
            parser.add_argument(flag, dest=name, type=kinds.get(name, type(value)), default=value)
    given = vars(parser.parse_args(args))
    source, target = given.pop("points"), given.pop("out")
    spark = SparkSession.builder.getOrCreate()
    got = run(spark.read.parquet(source), Options(**given))
    write_record(as_frame(spark, got.record), f"{target}/record")
    if not got.record["failure"]:
        write_trace(spark, got.trace, f"{target}/trace")
        write_centroids(spark, got.centroids, f"{target}/centroids")


if __name__ == "__main__":
    main()
