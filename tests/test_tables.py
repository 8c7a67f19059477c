from __future__ import annotations

import pytest

from vecloom.operators import prepare as pp
from vecloom.operators import report as rp
from vecloom.operators.positions import with_position


def test_min_max_drops_constants(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0), (3, None, 5.0)], "id int, a double, b double")
    rows = pp.min_max(df, ["a", "b"]).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 0.0), (2, 1.0), (3, None)]


def test_categories_are_bounded(spark):
    df = spark.range(20).selectExpr("cast(id as string) AS c")
    with pytest.raises(ValueError):
        pp.categories(df, "c", most=10)


def test_one_hot_of_null(spark):
    df = spark.createDataFrame([("a",), (None,)], "c string")
    assert sorted(tuple(r) for r in pp.one_hot(df, "c", ["a", "b"]).collect()) == [(0, 0), (1, 0)]


def test_label_encode_keeps_nulls(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    assert sorted((r["c"] or "", r["code"]) for r in pp.label_encode(df, "c").fillna(-1, ["code"]).collect()) == [("", -1), ("a", 0), ("b", 1), ("b", 1)]


def test_splits(spark):
    df = spark.range(10).toDF("id")
    assert pp.tail_split(df, "id", 3).filter("split = 'test'").agg({"id": "min"}).first()[0] == 7
    assert pp.tail_split(df.filter("id < 0"), "id", 3).count() == 0
    part = pp.hash_split(spark.range(10000).toDF("id"), "id", 0.3).filter("split = 'test'").count()
    assert 2700 < part < 3300


def test_positions_of_ties(spark):
    df = spark.createDataFrame([(v, i) for i, v in enumerate([3, 1, 2, 2, 2, 1, 9])], "v int, i int")
    rows = with_position(df, "v").orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(7)) and [r["v"] for r in rows] == [1, 1, 2, 2, 2, 3, 9]
    assert sorted(r["i"] for r in rows) == list(range(7)) and with_position(df.filter("false"), "v").count() == 0


def test_batches(spark):
    df = spark.range(10).toDF("id")
    assert pp.batches(df, "id", 4).groupBy("batch").count().count() == 3
    assert pp.batches(df, "id", 4, keep_last=False).count() == 8


def test_coerce_and_flags(spark):
    df = spark.createDataFrame([("1", "x", True, False), ("None", "2.5", False, True)], "a string, b string, f boolean, g boolean")
    rows = rp.coerce(df, {"a": "int", "b": "double"}).select("a", "b", rp.by_flags({"f": "first", "g": "second"}).alias("m")).collect()
    assert [tuple(r) for r in rows] == [(1, None, "first"), (None, 2.5, "second")]
    bad = spark.createDataFrame([(False, False)], "f boolean, g boolean").select(rp.by_flags({"f": "first", "g": "second"}).alias("m"))
    with pytest.raises(Exception, match="no flag holds"):
        bad.collect()


def test_curves_of_different_lengths(spark):
    rows = [("m", 1, 1, 10.0), ("m", 1, 2, 4.0), ("m", 1, 3, 2.0), ("m", 2, 1, 6.0)]
    traces = spark.createDataFrame(rows, "model string, run int, iter int, objective double")
    got = {r["iter"]: r for r in rp.padded_curves(traces).collect()}
    assert [got[i]["mean"] for i in (1, 2, 3)] == [8.0, 5.0, 4.0]
    assert [got[i]["high"] - got[i]["mean"] for i in (1, 2, 3)] == [2.0, 1.0, 2.0]
    assert [r["decreasing"] for r in rp.monotone(traces).collect()] == [True, True]


def test_records(spark, tmp_path):
    record = spark.createDataFrame([(None, 3, "x")], "z string, a int, m string")
    rp.write_record(record, str(tmp_path / "r"))
    back = rp.read_runs(spark, str(tmp_path / "r"))
    assert back.columns[:3] == ["a", "m", "z"] and back.first()["z"] is None


def test_single_value(spark):
    df = spark.createDataFrame([(1,), (None,), (1,)], "a int")
    assert df.agg(rp.single_value(df, "a").alias("a")).first()["a"] == 1
    two = spark.createDataFrame([(1,), (2,)], "a int")
    with pytest.raises(Exception, match="several values"):
        two.agg(rp.single_value(two, "a").alias("a")).collect()


def test_single_value(spark):
    """The only value of each group, nulls apart; several are an error."""
    from vecloom.operators.report import single_value

    df = spark.createDataFrame([("a", 8), ("a", None), ("a", 8), ("b", None), ("c", 4)], "g string, v int")
    assert sorted(tuple(r) for r in df.groupBy("g").agg(single_value(df, "v").alias("v")).collect()) == [("a", 8), ("b", None), ("c", 4)]
    more = df.union(spark.createDataFrame([("c", 5)], "g string, v int"))
    with pytest.raises(Exception, match="several values"):
        more.groupBy("g").agg(single_value(more, "v").alias("v")).collect()
