"""From many runs' records to comparison tables. Each function is one step of a single plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NULL_TOKEN = "None"


def read_runs(spark: SparkSession, path: str, schema: str | None = None, run: str = r"([^/]+?)(_results)?\.csv$") -> DataFrame:
    """All CSV records below a path, with the run they come from: what ``run`` finds in the file's path, by default its name without suffix."""
    reader = spark.read.option("header", True).option("nullValue", NULL_TOKEN)
    runs = (reader.schema(schema) if schema else reader).csv(path)
    return runs.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), run, 1))


def write_record(record: DataFrame, path: str) -> None:
    """Columns in the order of their names, missing values as None."""
    record.select(*sorted(record.columns)).write.option("header", True).option("nullValue", NULL_TOKEN).mode("overwrite").csv(path)


def grid(spark: SparkSession, **options: list) -> DataFrame:
    """Every combination of the options' values (lists a user wrote: their product is the table asked for)."""
    frames = [spark.createDataFrame([(v,) for v in values], [name]) for name, values in options.items()]
    return reduce(lambda a, b: a.join(F.broadcast(b)), frames)


def coerce(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns to their types; the null token and what doesn't parse become null."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(NULL_TOKEN)).try_cast(t) for c, t in types.items()})


def by_flags(flags: dict[str, str], otherwise: str | None = None) -> Column:
    """The name of the first flag that holds; an error in the row if none does and there is no default."""
    out = reduce(lambda w, f: w.when(F.col(f[0]), F.lit(f[1])), flags.items(), F.when(F.lit(False), F.lit("")))
    return out.otherwise(F.lit(otherwise) if otherwise is not None else F.raise_error(F.lit("no flag holds")).cast("string"))


def derived(df: DataFrame, dims: DataFrame) -> DataFrame:
    """n_flop = 2 n_param and compression = k * d / n_param, with d from a lookup by data set."""
    joined = df.join(F.broadcast(dims), "dataset")
    return joined.withColumns({"n_flop": F.col("n_param") * 2, "compression": F.col("k") * F.col("d") / F.when(F.col("n_param") != 0, F.col("n_param"))})


def mean_std(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and sample deviation (null for one run) of each group."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def at_largest(df: DataFrame, column: str) -> DataFrame:
    """Rows with the column's largest value."""
    return df.join(F.broadcast(df.agg(F.max(column).alias("_max"))), F.col(column) == F.col("_max")).drop("_max")


def compare(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b, on, "left")


def padded_curves(traces: DataFrame) -> DataFrame:
    """(model, iter, mean, low, high) of traces (model, run, iter, objective): each run goes on with its last value.

    A run's missing iterations are generated from its own length up to the model's longest, so only runs and
    lengths are joined; deviation is the population's.
    """
    ends = traces.groupBy("model", "run").agg(F.max("iter").alias("last_iter"), F.max_by("objective", "iter").alias("objective"))
    longest = ends.groupBy("model").agg(F.max("last_iter").alias("n"))
    tails = ends.join(longest, "model").filter("n > last_iter").select("model", "run", F.explode(F.sequence(F.col("last_iter") + 1, F.col("n"))).alias("iter"), "objective")
    full = traces.select("model", "run", "iter", "objective").unionByName(tails)
    stats = full.groupBy("model", "iter").agg(F.avg("objective").alias("mean"), F.stddev_pop("objective").alias("std"))
    return stats.select("model", "iter", "mean", (F.col("mean") - F.col("std")).alias("low"), (F.col("mean") + F.col("std")).alias("high"))


def monotone(traces: DataFrame) -> DataFrame:
    """(model, run, decreasing): whether no iteration's objective exceeds the one before it."""
    before = F.lag("objective").over(Window.partitionBy("model", "run").orderBy("iter"))
    steps = traces.withColumn("fine", F.coalesce(F.col("objective") <= before, F.lit(True)))
    return steps.groupBy("model", "run").agg(F.bool_and("fine").alias("decreasing"))


def best_two(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The two smallest values of each group, ranked; ties by name."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value, name))
    return df.withColumn("rank", rank).filter("rank <= 2")


def remaining(all_rows: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    return all_rows.join(done, on, "left_anti")


def classify(df: DataFrame, column: str, buckets: list[tuple[str, str]], otherwise: str = "other") -> DataFrame:
    """Rows counted by the first of the texts that the column contains."""
    first = reduce(lambda w, b: w.when(F.col(column).contains(b[0]), F.lit(b[1])), buckets, F.when(F.lit(False), F.lit("")))
    return df.select(first.otherwise(F.lit(otherwise)).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def command_lines(logs: DataFrame, column: str) -> DataFrame:
    """The command after "Command line: " of each log that has one."""
    found = F.regexp_extract(column, r"Command line: ([^\n]+)", 1)
    return logs.withColumn("command", found).filter(F.col("command") != "")


def logged_record(logs: DataFrame, column: str) -> DataFrame:
    """A map ``record`` from each log's first line that begins with -- (names) and the line after it (values)."""
    lines = F.split(column, "\n")
    at = F.array_position(F.transform(lines, lambda x: x.startswith("--")), True).cast("int")
    names, values = F.split(F.get(lines, at - 1), ","), F.split(F.get(lines, at), ",")
    return logs.withColumn("record", F.when(at > 0, F.map_from_arrays(names, values)))


def single_value(df: DataFrame, column: str) -> Column:
    """The column's only value other than null; an error if there are several."""
    return F.when(F.count_distinct(column) <= 1, F.max(column)).otherwise(F.raise_error(F.lit(f"{column} has several values")))


def union_runs(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
