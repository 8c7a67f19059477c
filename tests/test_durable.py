from __future__ import annotations

from types import SimpleNamespace

import pytest

from vecloom import durable, shipping


def session(setting: str | None, master: str, app: str):
    conf = SimpleNamespace(get=lambda key, default=None: setting if key == "spark.checkpoint.dir" else default)
    core = SimpleNamespace(get=lambda key, default=None: None)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: core, applicationId=app, master=master))


def test_the_sessions_folder_is_used():
    assert durable.shared_dir(session("hdfs://x/shared/", "yarn", "a")) == "hdfs://x/shared"


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "local-cluster[2,1,1024]"])
def test_no_local_folder_on_a_cluster(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        durable.shared_dir(session(None, master, "b"))


def test_tables_are_written_and_released(spark):
    table = durable.materialize(spark.range(10).selectExpr("id", "cast(null as string) AS s"), "test")
    assert table.count() == 10 and table.columns == ["id", "s"]
    path = table._durable_path
    assert path.startswith(durable.shared_dir(spark))
    durable.release(table)
    durable.release(spark.range(3))
    durable.release(None)
    with pytest.raises(Exception, match="(?i)not.*(exist|found)"):
        spark.read.parquet(path).count()


def test_hint_only_for_small_tables(spark):
    small = durable.materialize(spark.range(5), "test")
    hinted = lambda n: "hint" in durable.broadcast_if_small(small, n)._jdf.queryExecution().logical().toString().lower()
    assert hinted(5) and not hinted(4)


def test_batches_that_the_session_sets_stay(spark):
    shipping.ship(spark)
    before = spark.conf.get(shipping.BATCH_KEY)
    assert before == shipping.BATCH_BYTES
    spark.conf.set(shipping.BATCH_KEY, "1m")
    shipping.ship(spark)
    assert spark.conf.get(shipping.BATCH_KEY) == "1m"
    spark.conf.set(shipping.BATCH_KEY, before)
