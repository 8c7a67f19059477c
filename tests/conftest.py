from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SF


@pytest.fixture(scope="session")
def duck():
    """A function from SQL to (columns, rows) over the same tables."""
    import duckdb

    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")

    def ask(sql: str):
        got = con.sql(sql)
        return got.columns, got.fetchall()

    return ask


def plain(value):
    """A value that compares equal between the engines."""
    import decimal
    import math

    import numpy as np

    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, np.integer)):
        return int(value)
    if isinstance(value, (float, np.floating)):
        return float(value)
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in value)
    if isinstance(value, decimal.Decimal):
        raise TypeError("a decimal has no equal in Spark's results here")
    return str(value)


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Holds a query's rows against its SQL's, whatever their order."""
    from collections import Counter

    def check(query, sql: str) -> None:
        df = query(spark, SF)
        names, rows = duck(sql)
        order = sorted(names)
        assert sorted(df.columns) == order
        at = [names.index(n) for n in order]
        want = Counter(tuple(plain(r[i]) for i in at) for r in rows)
        got = Counter(tuple(plain(v) for v in r) for r in df.select(*order).collect())
        assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])

    return check
