"""SimHash fingerprints and their near-duplicate groups by multi-index hashing.

Fingerprints are cut into two segments of 32 bits. Two that differ in at most 2 (or 3) bits differ in at most
one bit of some segment, so each fingerprint looks up the ball of radius 1 around each of its segments (33
keys) in the table of all segments, and full distances decide. Only distinct fingerprints take part: copies
are a group by themselves, and a fingerprint has at most 2,080 others within distance 2, so no group of near
copies makes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.durable import broadcast_if_small, materialize
from vecloom.llm.common import map_batches, typed, utf8
from vecloom.llm.components import connected_components

SEGMENTS, SEGMENT_BITS = 2, 32
#: Words hashed at a time, so that a very long text needs little memory besides itself.
CHUNK = 1 << 16
#: Tables of two numbers a row are broadcast up to this many rows (some MB), else joined by shuffle.
MAX_BROADCAST_ROWS = 100_000


def _words(data: bytes):
    """Lists of at most CHUNK words; the ASCII white space of bytes.split is that of the contract."""
    if len(data) < 16 * CHUNK:
        words = data.split()
        return iter([words] if words else [])
    return _long(data)


def _long(data: bytes):
    import re

    found = (m.group() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data))
    while chunk := list(islice(found, CHUNK)):
        yield chunk


def shingle_hashes(data: bytes, shingle: int) -> Iterator[np.ndarray]:
    """The XXH64 (seed 42) of a UTF-8 text's word shingles in order, A-Z lower-cased; of fewer words the whole sequence's."""
    from xxhash import xxh64_intdigest

    found, kept = False, []
    for chunk in _words(data.lower()):  # bytes.lower changes A-Z only
        words = kept + chunk
        joined = b" ".join(words)
        if len(words) < shingle:
            kept = words
            continue
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        start = np.concatenate([[0], np.cumsum(length)])
        n = len(words) - shingle + 1
        begin, end = start[:n].tolist(), (start[shingle:] - 1).tolist()
        yield np.array([xxh64_intdigest(joined[i:j], 42) for i, j in zip(begin, end)], np.uint64)
        found, kept = True, words[-(shingle - 1) :] if shingle > 1 else []
    if kept and not found:
        yield np.array([xxh64_intdigest(b" ".join(kept), 42)], np.uint64)


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """Of a UTF-8 text: a bit is 1 if set in over half of the hashes of its word shingles, repeats included; no words: 0."""
    counts, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(data, shingle):
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, text_key, fingerprint long (the 64 bits as a signed number). Null and empty texts have fingerprint 0."""

    def run(batch: pa.RecordBatch) -> dict:
        made = np.array([fingerprint(x, shingle) for x in utf8(batch, "text")], np.uint64)
        return {"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "fingerprint": pa.array(made.view(np.int64))}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    return map_batches(rows, run, f"{typed(rows, 'doc_id')}, text_key long, fingerprint long")


def segment(value: Column, number: int) -> Column:
    return F.shiftrightunsigned(value, SEGMENT_BITS * number).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at most ``distance`` bits apart, each once. distance: 0 to 3."""
    if not 0 <= distance < 2 * SEGMENTS:
        raise ValueError("two segments with balls of radius 1 find distances up to 3")
    tag = lambda i, key: F.lit(i << SEGMENT_BITS).cast("long").bitwiseOR(key)
    table = prints.select(F.col("fingerprint").alias("b"), F.explode(F.array(*[tag(i, segment(F.col("fingerprint"), i)) for i in range(SEGMENTS)])).alias("key"))
    masks = F.array(*[F.lit(m).cast("long") for m in [0, *(1 << i for i in range(SEGMENT_BITS))]])
    balls = prints.select(F.col("fingerprint").alias("a"), F.explode(masks).alias("mask"))
    balls = balls.select("a", F.explode(F.array(*[tag(i, segment(F.col("a"), i).bitwiseXOR(F.col("mask"))) for i in range(SEGMENTS)])).alias("key"))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    # a pair that the first segment finds is not counted again for the second
    once = (F.col("key") < (1 << SEGMENT_BITS)) | (F.bit_count(segment(apart, 0)) > 1)
    near = (F.col("balls.key") == F.col("table.key")) & (F.col("a") < F.col("b")) & (F.bit_count(apart) <= distance)
    return balls.alias("balls").join(table.alias("table"), near).select("a", "b", F.col("balls.key").alias("key")).filter(once).select("a", "b")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach), n_links, group_key, text_key.

    group_key is the same for all documents of a component, text_key a hash of the text. Documents with equal fingerprints are linked; so are texts without words (fingerprint 0). n_links counts
    the other fingerprints within ``distance``. A null doc_id takes part but is no component's id unless
    all its ids are null. Repeated rows give repeated results; an empty table an empty one.
    """
    prints = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    distinct = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    edges = materialize(links(distinct.select("fingerprint"), distance), "links")
    members = connected_components(edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    first = distinct.join(members, distinct.fingerprint == members.node).select("node", "root", "first_id").join(degree, "node")
    first = materialize(first, "members")
    heads = materialize(first.groupBy("root").agg(F.min("first_id").alias("component_id")), "heads")
    linked = first.join(heads, "root").select(F.col("node").alias("fingerprint"), "component_id", "n_links", F.col("root").alias("group_key"))
    alone = distinct.join(first.select(F.col("node").alias("fingerprint")), "fingerprint", "left_anti")
    groups = linked.unionByName(alone.select("fingerprint", F.col("first_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.col("fingerprint").alias("group_key")))
    groups = materialize(groups, "groups")
    shown = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return prints.join(groups, "fingerprint").select("doc_id", shown.alias("fingerprint"), "component_id", "n_links", "group_key", "text_key")


def deduplicated(docs: DataFrame, found: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Documents, columns unchanged, one of each group: the one of smallest id, null last, then smallest text hash.

    ``found``: doc_id, text_key and group_key of every row (None: those of ``near_duplicates``). Rows that repeat
    the document that stays are one row of it. Only rows that go, and repeated ones, are looked up: where these
    are few, no text is shuffled. An empty table gives an empty one.
    """
    if found is None:
        found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    found = materialize(found.select("doc_id", "text_key", "group_key"), "grouped")
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")
    stays = materialize(found.groupBy("group_key").agg(F.min(rank).alias("stays")), "stays")
    marked = found.join(stays, "group_key").withColumn("gone", ~(F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_key") == F.col("stays.text_key"))))
    counted = marked.groupBy("doc_id", "text_key").agg(F.bool_or("gone").alias("gone"), F.count(F.lit(1)).alias("n"))
    counted = materialize(counted.filter("gone OR n > 1"), "counted")

    rows = docs.alias("d")
    key = F.col(f"d.{id_col}").eqNullSafe(F.col("m.doc_id")) & (F.xxhash64(F.col(f"d.{text_col}")) == F.col("m.text_key"))
    kept = rows.join(broadcast_if_small(counted, MAX_BROADCAST_ROWS).alias("m"), key, "left_anti")
    repeated = materialize(counted.filter("NOT gone"), "repeated")
    if repeated.isEmpty():
        return kept
    once = rows.join(broadcast_if_small(repeated, MAX_BROADCAST_ROWS).alias("m"), key, "left_semi").dropDuplicates([id_col, text_col])
    return kept.unionByName(once)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")
