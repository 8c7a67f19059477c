"""Queries of feature preparation and of the report layer."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.durable import new_path
from vecloom.operators import prepare as pp
from vecloom.operators import report as rp
from vecloom.plans.clustering import rounded
from vecloom.plans.registry import POINTS, gaussian, query, text, uniform
from vecloom.sources.tables import dataset, load, points, read_centroids, read_delimited, read_raw_matrix, write_centroids, write_trace


@query(
    "WITH s AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, round((l_quantity - a) / (b - a), 6) AS l_quantity, round((l_extendedprice - c) / (d - c), 6) AS l_extendedprice FROM lineitem, s"
)
def minmax_drop_constant(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.lit(1.0).alias("constant"))
    scaled = pp.min_max(rows, ["l_quantity", "l_extendedprice", "constant"])
    return scaled.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in scaled.columns[2:]])


@query(
    "SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'A' AS INTEGER) AS l_returnflag_A, CAST(l_returnflag = 'N' AS INTEGER) AS l_returnflag_N, CAST(l_returnflag = 'R' AS INTEGER) AS l_returnflag_R FROM lineitem"
)
def one_hot(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return pp.one_hot(rows, "l_returnflag", pp.categories(rows, "l_returnflag"))


_EVENTS = ["click", "purchase", "view"]


@query("SELECT user_id, " + ", ".join(f"CAST(max(CASE WHEN event_type = '{v}' THEN 1 ELSE 0 END) AS INTEGER) AS has_{v}" for v in _EVENTS) + " FROM events GROUP BY user_id")
def multi_hot(spark, sf_dir):
    return pp.multi_hot(load(spark, sf_dir, "events"), "user_id", "event_type", _EVENTS)


@query("SELECT CAST(user_id AS VARCHAR) AS key, " + ", ".join(f"CAST(max(CASE WHEN event_type = '{v}' THEN 1 ELSE 0 END) AS INTEGER) AS has_{v}" for v in _EVENTS) + " FROM events GROUP BY user_id")
def multi_hot_lines(spark, sf_dir):
    """Ragged lines "key,attribute,attribute..." made of the events, and parsed again."""
    seen = load(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("seen"))
    lines = seen.select(F.concat_ws(",", F.col("user_id").cast("string"), "seen").alias("value"))
    return pp.split_multi_hot(lines, "value", _EVENTS)


@query("SELECT p_partkey, p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS code FROM part")
def label_encode(spark, sf_dir):
    return pp.label_encode(load(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "p_brand", "code")


def _centered(extra: str) -> str:
    return (
        f"WITH {POINTS}, l AS (SELECT id, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM p), s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS sd FROM l GROUP BY i) "
        f"SELECT id, CAST(l.i AS INTEGER) AS pos, round((v - m){extra}, 6) + 0.0 AS value FROM l JOIN s ON l.i = s.i"
    )


@query(_centered(""))
def mean_center(spark, sf_dir):
    return pp.mean_center(points(spark, sf_dir).select("id", "x")).select("id", F.posexplode("x").alias("pos", "value")).select("id", "pos", rounded("value"))


@query(_centered(" / sd"))
def standardize(spark, sf_dir):
    return pp.mean_center(points(spark, sf_dir).select("id", "x"), True).select("id", F.posexplode("x").alias("pos", "value")).select("id", "pos", rounded("value"))


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey DESC) <= 1000 THEN 'test' ELSE 'train' END AS split FROM orders")
def tail_split(spark, sf_dir):
    return pp.tail_split(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 1000)


@query(
    "SELECT vec_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) <= floor(count(*) OVER (PARTITION BY label) * 0.33) THEN 'test' ELSE 'train' END AS split FROM embeddings"
)
def stratified_split(spark, sf_dir):
    return pp.stratified_split(load(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", "label", 0.33)


_BLOB = f"{uniform(repr('1'), repr('c'), text('id % 8'), text('i'))} * 20.0 - 10.0 + {gaussian(repr('1'), text('id'), text('i'))}"


@query(f"SELECT id, CAST(id % 8 AS INTEGER) AS label, CAST(i - 1 AS INTEGER) AS pos, round({_BLOB}, 6) + 0.0 AS value FROM (SELECT unnest(range(0, 500)) AS id), (SELECT unnest(range(1, 5)) AS i)")
def blobs(spark, sf_dir):
    rows = pp.blobs(spark, 500, 4, 8, seed=1).select("id", "label", F.posexplode("x").alias("pos", "value"))
    return rows.withColumn("value", F.round("value", 6) + 0.0)


@query("SELECT l_orderkey AS id, round(sum(l_quantity + l_extendedprice + l_discount + l_tax), 4) AS total FROM lineitem GROUP BY l_orderkey")
def feature_vectors(spark, sf_dir):
    rows = dataset(spark, sf_dir, "lineitem")
    return rows.groupBy("id").agg(F.round(F.sum(F.aggregate("x", F.lit(0.0), lambda s, v: s + v)), 4).alias("total"))


@query("SELECT n_nationkey AS key, upper(n_name) AS name FROM nation")
def csv_round_trip(spark, sf_dir):
    path = new_path(spark, "csv")
    load(spark, sf_dir, "nation").select(F.lit("x").alias("drop_me"), "n_nationkey", F.upper("n_name").alias("n")).write.csv(path)
    return read_delimited(spark, path, "a string, key int, name string", drop=1)


@query("SELECT CAST(r_regionkey AS VARCHAR) AS key, replace(r_name, ' ', '_') AS name FROM region")
def whitespace_table(spark, sf_dir):
    path = new_path(spark, "blank")
    load(spark, sf_dir, "region").select(F.concat_ws("   ", F.col("r_regionkey").cast("string"), F.replace("r_name", F.lit(" "), F.lit("_")))).write.text(path)
    return read_delimited(spark, path, sep=None).toDF("key", "name")


@query("SELECT CAST(row AS BIGINT) AS row, CAST(i AS INTEGER) AS pos, CAST(row * 4 + i AS DOUBLE) AS value FROM (SELECT unnest(range(0, 25)) AS row), (SELECT unnest(range(0, 4)) AS i)")
def raw_matrix(spark, sf_dir):
    """Headerless float32 rows: encoded with Spark into a binary column's file form, then read back."""
    import numpy as np

    path = new_path(spark, "raw")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/part.dat")
    out = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(fs)
    out.write(bytearray(np.arange(100, dtype="<f4").tobytes()))
    out.close()
    return read_raw_matrix(spark, path, 4).select("row", F.posexplode("x").alias("pos", "value"))


@query("SELECT CAST(k AS INTEGER) AS k, CAST(i AS INTEGER) AS pos, round(v, 6) + 0.0 AS value FROM (SELECT vec_id AS k, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(0, 64)) AS i FROM embeddings WHERE vec_id < 5)")
def model_round_trip(spark, sf_dir):
    from vecloom.plans.clustering import coordinates
    from vecloom.sources.tables import first_rows

    path = new_path(spark, "model")
    write_centroids(spark, first_rows(points(spark, sf_dir), 5), path)
    return coordinates(spark, read_centroids(spark, path))


@query("SELECT CAST(i AS INTEGER) AS iter, CAST(100 - i * i AS DOUBLE) AS objective FROM (SELECT unnest(range(0, 6)) AS i)")
def trace_round_trip(spark, sf_dir):
    path = new_path(spark, "trace")
    write_trace(spark, [100.0 - i * i for i in range(6)], path)
    return spark.read.parquet(path)


def runs(spark, sf_dir: str) -> DataFrame:
    """Records of runs as text: one for each (nation, segment, status) of orders, standing for data set, model and seed."""
    customer, orders = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    kind = F.col("c_nationkey") % 3
    got = joined.groupBy((F.col("c_nationkey") % 4).alias("dataset"), kind.alias("model"), F.col("o_orderstatus").alias("seed"), (F.col("c_nationkey") % 5).alias("size")).agg(
        F.round(F.avg("o_totalprice"), 2).alias("objective"), F.count(F.lit(1)).alias("n_param")
    )
    return got.select(
        F.concat(F.lit("d"), F.col("dataset").cast("string")).alias("dataset"),
        (F.col("model") == 0).alias("kmeans"),
        (F.col("model") == 1).alias("two_step"),
        (F.col("model") == 2).alias("factorized"),
        "seed",
        (F.col("size") * 8 + 8).cast("string").alias("k"),
        F.when(F.col("n_param") % 7 == 0, F.lit("None")).otherwise(F.col("objective").cast("string")).alias("objective"),
        F.col("n_param").cast("string").alias("n_param"),
    )


_R = """r AS (SELECT 'd' || dataset AS dataset, CASE model WHEN 0 THEN 'kmeans' WHEN 1 THEN 'two_step' ELSE 'factorized' END AS model, seed, CAST(size * 8 + 8 AS INTEGER) AS k,
  CASE WHEN n_param % 7 = 0 THEN NULL ELSE objective END AS objective, n_param
FROM (SELECT c_nationkey % 4 AS dataset, c_nationkey % 3 AS model, o_orderstatus AS seed, c_nationkey % 5 AS size, round(avg(o_totalprice), 2) AS objective, count(*) AS n_param
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4))"""

MODELS = {"kmeans": "kmeans", "two_step": "two_step", "factorized": "factorized"}


def typed(spark, sf_dir: str) -> DataFrame:
    rows = rp.coerce(runs(spark, sf_dir), {"k": "int", "objective": "double", "n_param": "long"})
    return rows.withColumn("model", rp.by_flags(MODELS)).drop(*MODELS)


@query(f"WITH {_R} SELECT dataset, model, seed, k, objective, n_param FROM r")
def results_coerce(spark, sf_dir):
    return typed(spark, sf_dir).select("dataset", "model", "seed", "k", "objective", "n_param")


@query(f"WITH {_R} SELECT model, count(*) AS n FROM r GROUP BY model")
def model_case(spark, sf_dir):
    return typed(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def dims(spark) -> DataFrame:
    return spark.createDataFrame([(f"d{i}", 16 * (i + 1)) for i in range(4)], "dataset string, d int")


@query(f"WITH {_R} SELECT dataset, model, seed, k, n_param * 2 AS n_flop, round(CAST(k * 16 * (CAST(substr(dataset, 2) AS INTEGER) + 1) AS DOUBLE) / n_param, 6) AS compression FROM r")
def derived_metrics(spark, sf_dir):
    return rp.derived(typed(spark, sf_dir), dims(spark)).select("dataset", "model", "seed", "k", "n_flop", rounded("compression"))


@query(f"WITH {_R} SELECT dataset, model, count(objective) AS n, round(avg(objective), 6) AS mean, round(stddev_samp(objective), 6) AS std FROM r GROUP BY dataset, model")
def group_mean_std(spark, sf_dir):
    return rp.mean_std(typed(spark, sf_dir), ["dataset", "model"], "objective").select("dataset", "model", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {_R} SELECT dataset, model, seed, k FROM r WHERE k = (SELECT max(k) FROM r)")
def max_param_filter(spark, sf_dir):
    return rp.at_largest(typed(spark, sf_dir), "k").select("dataset", "model", "seed", "k")


@query(f"WITH {_R} SELECT a.dataset, a.k, a.seed, a.n_param, b.n_param AS other FROM (SELECT * FROM r WHERE model = 'kmeans') a LEFT JOIN (SELECT * FROM r WHERE model = 'factorized') b ON a.dataset = b.dataset AND a.k = b.k AND a.seed = b.seed")
def compare_join(spark, sf_dir):
    rows = typed(spark, sf_dir)
    other = rows.filter("model = 'factorized'").select("dataset", "k", "seed", F.col("n_param").alias("other"))
    return rp.compare(rows.filter("model = 'kmeans'").select("dataset", "k", "seed", "n_param"), other, ["dataset", "k", "seed"])


@query(f"WITH {_R}, l AS (SELECT 'd' || i AS dataset, 248000 + 1000 * i AS lim FROM (SELECT unnest(range(0, 4)) AS i)) SELECT r.dataset, model, seed, k FROM r JOIN l ON r.dataset = l.dataset WHERE objective <= lim")
def lookup_filter(spark, sf_dir):
    limits = spark.createDataFrame([(f"d{i}", 248000 + 1000 * i) for i in range(4)], "dataset string, lim int")
    return typed(spark, sf_dir).join(F.broadcast(limits), "dataset").filter("objective <= lim").select("dataset", "model", "seed", "k")


@query("SELECT CAST(k AS INTEGER) AS k, CAST(seed AS INTEGER) AS seed, model FROM (SELECT unnest([8, 16, 32]) AS k), (SELECT unnest(range(0, 5)) AS seed), (SELECT unnest(['kmeans', 'two_step', 'factorized']) AS model)")
def grid_expand(spark, sf_dir):
    got = rp.grid(spark, k=[8, 16, 32], seed=list(range(5)), model=["kmeans", "two_step", "factorized"])
    return got.select(F.col("k").cast("int").alias("k"), F.col("seed").cast("int").alias("seed"), "model")


def traces(spark, sf_dir: str) -> DataFrame:
    """Objective traces: an order is a run, its lines are iterations, the remaining price is the objective."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_returnflag").agg(F.sum("l_extendedprice").alias("price"))
    rows = lines.groupBy("l_orderkey", "l_linenumber").agg(F.sum("price").alias("price"), F.min("l_returnflag").alias("flag"))
    run = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    every = Window.partitionBy("l_orderkey")
    return rows.select(
        F.min("flag").over(every).alias("model"), F.col("l_orderkey").alias("run"), F.row_number().over(run).alias("iter"), (F.sum("price").over(every) / F.row_number().over(run) + F.col("price") * 0.1).alias("objective")
    )


_TR = """l AS (SELECT l_orderkey, l_linenumber, sum(l_extendedprice) AS price, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2),
t AS (SELECT min(flag) OVER (PARTITION BY l_orderkey) AS model, l_orderkey AS run, CAST(row_number() OVER w AS INTEGER) AS iter,
  sum(price) OVER (PARTITION BY l_orderkey) / row_number() OVER w + price * 0.1 AS objective FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))"""


@query(
    f"WITH {_TR}, n AS (SELECT model, max(iter) AS n FROM t GROUP BY model), g AS (SELECT r.model, r.run, unnest(range(1, n.n + 1)) AS iter FROM (SELECT DISTINCT model, run FROM t) r JOIN n ON r.model = n.model), "
    "f AS (SELECT g.model, g.run, g.iter, last_value(t.objective IGNORE NULLS) OVER (PARTITION BY g.model, g.run ORDER BY g.iter) AS objective FROM g LEFT JOIN t ON g.model = t.model AND g.run = t.run AND g.iter = t.iter) "
    "SELECT model, CAST(iter AS INTEGER) AS iter, round(avg(objective), 4) AS mean, round(avg(objective) - stddev_pop(objective), 4) AS low, round(avg(objective) + stddev_pop(objective), 4) AS high FROM f GROUP BY model, iter"
)
def loss_curve_padded(spark, sf_dir):
    return rp.padded_curves(traces(spark, sf_dir)).select("model", "iter", *[F.round(c, 4).alias(c) for c in ("mean", "low", "high")])


@query(f"WITH {_TR} SELECT model, run, bool_and(fine) AS decreasing FROM (SELECT *, coalesce(objective <= lag(objective) OVER (PARTITION BY model, run ORDER BY iter), true) AS fine FROM t) GROUP BY model, run")
def monotone_check(spark, sf_dir):
    return rp.monotone(traces(spark, sf_dir))


@query(f"WITH {_R} SELECT dataset, k, seed, model, n_param, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset, seed ORDER BY n_param, model, k) AS rank FROM r) WHERE rank <= 2")
def best_second(spark, sf_dir):
    rows = typed(spark, sf_dir).withColumn("name", F.concat("model", F.lpad(F.col("k").cast("string"), 4, "0")))
    return rp.best_two(rows, ["dataset", "seed"], "n_param", "name").select("dataset", "k", "seed", "model", "n_param", "rank")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_difference(spark, sf_dir):
    done = load(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return rp.remaining(load(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


_BUCKETS = [(str(d), name) for d, name in enumerate(("memory", "time limit", "killed", "not found", "singular", "disk", "syntax", "import", "overflow", "nan"))]
_CASE = " ".join(f"WHEN contains(t, '{text}') THEN '{name}'" for text, name in _BUCKETS)


@query(f"SELECT bucket, count(*) AS n FROM (SELECT CASE {_CASE} ELSE 'other' END AS bucket FROM (SELECT CASE WHEN p_partkey % 9 = 0 THEN p_type ELSE CAST(p_partkey % 97 AS VARCHAR) END AS t FROM part)) GROUP BY bucket")
def log_classify(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 9 == 0, F.col("p_type")).otherwise((F.col("p_partkey") % 97).cast("string"))
    return rp.classify(load(spark, sf_dir, "part").select(text.alias("t")), "t", _BUCKETS)


@query("SELECT event_id, CAST(event_id AS VARCHAR) || ' --kind ' || event_type AS command FROM events WHERE event_id % 2 = 0")
def log_commands(spark, sf_dir):
    text = F.concat(F.lit("start\n"), F.when(F.col("event_id") % 2 == 0, F.lit("Command line: ")).otherwise(F.lit("none ")), F.col("event_id").cast("string"), F.lit(" --kind "), F.col("event_type"), F.lit("\nend"))
    logs = load(spark, sf_dir, "events").select("event_id", text.alias("log"))
    return rp.command_lines(logs, "log").select("event_id", "command")


@query("SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS run FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_id % 3 = 0")
def log_records(spark, sf_dir):
    head = F.when(F.col("event_id") % 3 != 0, F.lit("--kind,--run\n")).otherwise(F.lit("kind,run\n"))
    text = F.concat(F.lit("start\n"), head, F.col("event_type"), F.lit(","), F.col("user_id").cast("string"), F.lit("\nend"))
    logs = rp.logged_record(load(spark, sf_dir, "events").select("event_id", text.alias("log")), "log")
    return logs.select("event_id", F.col("record")["--kind"].alias("kind"), F.col("record")["--run"].alias("run"))


@query(f"WITH {_R} SELECT dataset, model, CAST(NULL AS INTEGER) AS k, seed FROM r WHERE model = 'two_step' UNION ALL SELECT dataset, model, k, NULL FROM r WHERE model <> 'two_step'")
def union_runs(spark, sf_dir):
    rows = typed(spark, sf_dir)
    return rp.union_runs([rows.filter("model = 'two_step'").select("dataset", "model", "seed"), rows.filter("model <> 'two_step'").select("dataset", "model", "k")])


@query(f"WITH {_R} SELECT dataset, coalesce(CAST(objective AS VARCHAR), 'None') = 'None' AS missing, count(*) AS n FROM r GROUP BY 1, 2")
def null_fill(spark, sf_dir):
    rows = typed(spark, sf_dir).withColumn("shown", F.col("objective").cast("string")).na.fill("None", ["shown"])
    return rows.groupBy("dataset", (F.col("shown") == "None").alias("missing")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_R} SELECT DISTINCT dataset, k FROM r")
def distinct_sorted(spark, sf_dir):
    return typed(spark, sf_dir).select("dataset", "k").distinct().orderBy("dataset", "k")


@query(f"WITH {_R} SELECT dataset, model, seed, k FROM r WHERE NOT (model = 'two_step') AND (dataset IN ('d0', 'd2') OR seed = 'F')")
def boolean_filter(spark, sf_dir):
    rows = typed(spark, sf_dir)
    return rows.filter(~(F.col("model") == "two_step") & (F.col("dataset").isin("d0", "d2") | (F.col("seed") == "F"))).select("dataset", "model", "seed", "k")


@query(f"WITH {_R} SELECT dataset, max(CASE WHEN objective > 0 THEN 16 * (CAST(substr(dataset, 2) AS INTEGER) + 1) END) AS unit FROM r GROUP BY dataset")
def single_value(spark, sf_dir):
    """The width of each data set, known from those of its runs that have an objective."""
    rows = typed(spark, sf_dir).withColumn("unit", F.when(F.col("objective") > 0, (F.substring("dataset", 2, 9).cast("int") + 1) * 16))
    return rows.groupBy("dataset").agg(rp.single_value(rows, "unit").alias("unit"))


@query("SELECT CAST(c_nationkey AS VARCHAR) AS run, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_nationkey")
def scan_runs(spark, sf_dir):
    """CSV files of many runs, read together with the run's name from the path."""
    path = new_path(spark, "runs")
    rows = load(spark, sf_dir, "customer").select("c_nationkey", F.col("c_acctbal").cast("string").alias("objective"))
    rows.write.option("header", True).partitionBy("c_nationkey").csv(path)
    back = rp.read_runs(spark, path, "objective string", r"/c_nationkey=([0-9]+)/[^/]+$")
    return back.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("objective").cast("double")), 2).alias("total"))


@query(f"WITH {_R} SELECT DISTINCT dataset, model, k FROM r")
def drop_duplicate_params(spark, sf_dir):
    return typed(spark, sf_dir).dropDuplicates(["dataset", "model", "k"]).select("dataset", "model", "k")
