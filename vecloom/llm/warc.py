"""A content-addressed WARC archive.

Payload bytes are stored once by their SHA-256; the exact header bytes of every record are stored apart.
Reading verifies each stored payload against its digest and joins headers and payloads back to records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.durable import new_path

DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base 32: its 40 hex digits, five at a time, are four digits each."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), DIGITS, BASE32)


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n"))


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0, date: str = DATE) -> None:
    """Writes one record a row below ``path``: payloads/ (digest, response_id, payload) and headers/ (page_id, digest, header).

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the smallest id is a response
    and the others revisit it; smaller payloads are stored once too, but their records are all responses.
    A null body is an empty payload. A null id never is the smallest unless all are null, and then these
    records are responses; rows that repeat the smallest id are responses as well. Line breaks in a url are
    percent-encoded in its header. Other columns are dropped. An empty table gives an empty archive; a payload is
    one value, whatever its length. Ids keep their type.
    """
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # partial aggregates keep one payload of each digest before the shuffle, however many copies there are
    stored = rows.groupBy("digest").agg(F.min("page_id").alias("response_id"), F.any_value("payload").alias("payload"))
    stored.write.parquet(f"{path}/payloads")
    first = pages.sparkSession.read.parquet(f"{path}/payloads").select("digest", "response_id")
    slim = rows.select("page_id", "url", "digest", F.length("payload").alias("size"), base32_sha1(F.col("payload")).alias("sha1"))
    slim = slim.join(first, "digest")
    revisit = (F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    safe_url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(F.col(c).cast("string")), F.lit("")), F.lit(">"))
    warc = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", urn("page_id")),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", safe_url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")).otherwise(F.lit("")),
        F.when(revisit, _line("WARC-Refers-To", urn("response_id"))).otherwise(F.lit("")),
        _line("Content-Type", "application/http;msgtype=response"),
        _line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        http,
    )
    slim.select("page_id", "digest", warc.cast("binary").alias("header")).write.parquet(f"{path}/headers")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload, payload_bytes, payload_digest (SHA-1 in base 32); fails if a payload is not what its digest says."""
    stored = spark.read.parquet(f"{path}/payloads")
    wrong = F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(wrong.cast("binary"))
    stored = stored.select("digest", checked.alias("payload"))
    return stored.select("digest", "payload", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """page_id, digest, header, and what the header says: record_type, url, refers_to, header_digest."""
    rows = spark.read.parquet(f"{path}/headers")
    text = F.decode("header", "UTF-8")
    refers = F.regexp_extract(text, r"\r\nWARC-Refers-To: <urn:page:([^>\r\n]+)>\r\n", 1)
    return rows.select(
        "page_id",
        "digest",
        "header",
        F.regexp_extract(text, r"^WARC/1.1\r\nWARC-Type: ([a-z]+)\r\n", 1).alias("record_type"),
        F.regexp_extract(text, r"\r\nWARC-Target-URI: ([^\r\n]*)\r\n", 1).alias("url"),
        F.when(refers != "", F.url_decode(refers).try_cast(rows.schema["page_id"].dataType)).alias("refers_to"),
        F.regexp_extract(text, r"\r\nWARC-Payload-Digest: sha1:([A-Z2-7]+)\r\n", 1).alias("header_digest"),
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, record.

    ``record`` is the exact record: header and, for a response, the payload, then two line ends. Columns that
    are not asked for are not joined: without payload and record only digests and lengths move. An empty archive
    gives an empty table; repeated ids are records of their own; long payloads are read whole.
    """
    joined = read_headers(spark, path).join(read_payloads(spark, path), "digest")
    agrees = F.when(F.col("header_digest") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header's digest is not its payload's")).cast("string"))
    end = F.lit("\r\n\r\n").cast("binary")
    record = F.when(F.col("record_type") == "revisit", F.concat("header", end)).otherwise(F.concat("header", "payload", end))
    return joined.select("page_id", "url", "record_type", "refers_to", "payload_bytes", agrees.alias("payload_digest"), "payload", record.alias("record"))


def rebuilt(records: DataFrame) -> DataFrame:
    """The records of ``read_archive``; fails if a response's record has not the payload of its digest, or a revisit's has one."""
    start = F.octet_length("record") - F.col("payload_bytes").cast("int") - 3
    held = F.when(start > 0, base32_sha1(F.substring("record", start, F.col("payload_bytes").cast("int"))))
    none = F.substring("record", -8, 8) == F.lit("\r\n" * 4).cast("binary")
    right = F.when(F.col("record_type") == "revisit", none).otherwise(held == F.col("payload_digest"))
    wrong = F.raise_error(F.lit("a record is not what was archived")).cast("string")
    return records.withColumn("payload_digest", F.when(F.coalesce(right, F.lit(False)), F.col("payload_digest")).otherwise(wrong))


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
b AS (
  SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first_id,
         translate(concat({parts}), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM b
""".replace("{parts}", ", ".join(f"upper(to_base(CAST('0x' || substr(x, {1 + 5 * i}, 5) AS BIGINT), 32, 4))" for i in range(8)))


def query(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return rebuilt(read_archive(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
