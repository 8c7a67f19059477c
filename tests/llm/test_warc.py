from __future__ import annotations

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from vecloom.durable import new_path
from vecloom.llm import warc

ROWS = [(1, "http://a/", "<p>x</p>", "z"), (2, "http://b/", "<p>x</p>", "z"), (3, None, "<p>x</p>", None), (4, "http://c/\r\nWARC-Type: x", "é", "z"), (5, "u", "", "z"), (6, "u", None, "z"), (7, "u", "y" * 200_000, "z"), (7, "u", "y" * 200_000, "z"), (None, "u", "é", "z"), (None, "u", "only", "z")]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string, digest string")


def test_round_trip(spark, pages):
    path = new_path(spark, "warc-test")
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({r[2] or "" for r in ROWS})
    got = warc.read_archive(spark, path).collect()
    assert len(got) == len(ROWS)
    smallest = {}
    for i, _, body, _ in ROWS:
        if i is not None:
            smallest[body or ""] = min(i, smallest.get(body or "", i))
    for r in got:
        body = bytes(r["payload"])
        first = smallest.get(body.decode())
        assert r["payload_bytes"] == len(body)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == first else ("revisit", first))
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and fields["WARC-Type"] == r["record_type"] and rest.endswith(b"\r\n\r\n")
        block = rest[:-4]
        assert len(block) == int(fields["Content-Length"])
        assert block.partition(b"\r\n\r\n")[2] == (body if r["record_type"] == "response" else b"")
    bodies = sorted((r[0] or 0, r[2] or "") for r in ROWS)
    assert sorted((r["page_id"] or 0, bytes(r["payload"]).decode()) for r in got) == bodies


def test_small_payloads_are_responses(spark, pages):
    path = new_path(spark, "warc-test")
    warc.write_archive(pages, path, min_bytes=100)
    kinds = {(r["page_id"], r["record_type"]) for r in warc.read_archive(spark, path).collect()}
    assert kinds == {(r[0], "response") for r in ROWS}


def test_damage_is_found(spark, pages):
    path = new_path(spark, "warc-test")
    warc.write_archive(pages, path)
    stored = spark.read.parquet(f"{path}/payloads").selectExpr("digest", "response_id", "cast('other' AS binary) AS payload")
    stored.write.parquet(f"{path}/broken/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_payloads(spark, f"{path}/broken").collect()


def test_no_pages(spark, pages):
    path = new_path(spark, "warc-test")
    warc.write_archive(pages.filter("false"), path)
    assert warc.read_archive(spark, path).count() == 0


def damaged(records, kind):
    record = F.when(F.col("record_type") == kind, F.concat("record", F.lit(b"x"))).otherwise(F.col("record"))
    return records.withColumn("record", record)


def test_query_rebuilds_records(spark, sf_dir, monkeypatch):
    """A record that is put together wrongly fails the query."""
    read = warc.read_archive
    monkeypatch.setattr(warc, "read_archive", lambda *a: damaged(read(*a), "response"))
    with pytest.raises(Exception, match="not what was archived"):
        warc.query(spark, sf_dir).collect()


def test_rebuilt_records_of_both_kinds(spark, pages):
    path = new_path(spark, "test-warc")
    warc.write_archive(pages, path)
    records = warc.read_archive(spark, path)
    assert warc.rebuilt(records).filter("payload_digest is not null").count() == len(ROWS)
    for kind in ("response", "revisit"):
        assert records.filter(F.col("record_type") == kind).count() > 0
        with pytest.raises(Exception, match="not what was archived"):
            warc.rebuilt(damaged(records, kind)).collect()
