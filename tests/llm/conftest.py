from __future__ import annotations

import pytest

LONG = "lorem ipsum dolor " * 20_000

#: id, text, lang, source, n_chars and a column whose name several operators use inside
ROWS = [
    (1, "The cat sat on the mat. You are a moron!\nWrite to bob@mail.example.com or +1 (234) 555-1234 today.", "en", "a", 10, "x"),
    (2, "Der Hund und die Katze sind in dem Haus.\nDer Hund und die Katze sind in dem Haus.", "de", "a", 10, None),
    (2, "Der Hund und die Katze sind in dem Haus.\nDer Hund und die Katze sind in dem Haus.", "de", "a", 10, None),
    (3, "", "en", "b", 0, "x"),
    (4, None, None, None, None, None),
    (5, LONG, "en", "b", len(LONG), "x"),
    (6, "1234 5678 --- 42 \u2581 \U0001f600", None, "b", 3, "x"),
    (7, "\x00 \t\x0b\x0c\r\n word\u00a0joined \u2003", "fr", None, 3, "x"),
    (None, "a text without an id", "en", "a", 3, "x"),
    (8, "a text without an id", "en", "a", 3, "x"),
    (9, " ", "en", "c", 1, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string"
#: more names that operators use inside
CLASHES = ["size", "range", "offset", "term", "fingerprint", "root", "node", "bucket", "digest", "words", "score", "_id", "_text"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
