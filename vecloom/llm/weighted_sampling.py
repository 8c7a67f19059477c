"""Document fingerprints by consistent weighted sampling.

Each text is the multiset of its lower-cased words, weighted by their number. For every slot k and term the
term's hash seeds two Gamma(2,1) variables r, c and a uniform b; with t = floor(ln(w)/r + b) the term's sample
is ln(c) - r*(t - b) - r, and the slot holds the (term, t) whose sample is least. Two texts agree in a slot
with probability sum(min(w)) / sum(max(w)), the generalised Jaccard similarity of their weights.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.shipping import ship

#: (term, weight) pairs whose samples a Python worker keeps; all are dropped when it is full.
CACHE = 1 << 17
#: Buckets of consecutive documents for each shuffle partition; their bounds are quantiles of the ids.
BUCKETS_EACH, MAX_BUCKETS = 8, 20_000


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Fingerprints of ``slots`` slots, 4 hex digits each. A text without words has all zeros."""

    def __init__(self, slots: int = 64, seed: int = 1):
        self.slots = slots
        steps = np.arange(1, 3 * slots + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.steps = _mix(steps + np.uint64(seed)).reshape(3, slots)
        self.index: dict[tuple[bytes, int], int] = {}
        self.value = np.empty((CACHE, slots), np.float32)
        self.level = np.empty((CACHE, slots), np.int32)
        self.hash = np.empty(CACHE, np.uint64)

    def samples(self, hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For hashes and weights of terms: the values that compete in each slot, and the levels t of the weights."""
        weight = np.log(weights).astype(np.float32)[:, None]

        def uniforms(i: int) -> tuple[np.ndarray, np.ndarray]:
            """Two of 24 bits, strictly between 0 and 1, from each word of 64."""
            mixed = _mix(hashes[:, None] ^ self.steps[i])
            parts = mixed >> np.uint64(40), (mixed >> np.uint64(16)) & np.uint64(0xFFFFFF)
            return tuple((x.astype(np.float32) + np.float32(0.5)) * np.float32(2**-24) for x in parts)

        u, v = uniforms(0)
        r = -np.log(u * v)
        u, v = uniforms(1)
        log_c = np.log(-np.log(u * v))
        b, _ = uniforms(2)
        t = np.floor(weight / r + b)
        return log_c - r * (t - b) - r, t.astype(np.int32)

    def rows(self, terms: list[tuple[bytes, int]]) -> np.ndarray:
        """Places of the terms' samples, made where they are new."""
        from xxhash import xxh64_intdigest

        index = self.index
        found = [index.get(x, -1) for x in terms]
        if -1 in found:
            new = [x for x, i in zip(terms, found) if i < 0]
            if len(index) + len(new) > CACHE:
                index.clear()
                new = terms
            at, end = len(index), len(index) + len(new)
            self.hash[at:end] = [xxh64_intdigest(t, 7) for t, _ in new]
            self.value[at:end], self.level[at:end] = self.samples(self.hash[at:end], np.array([w for _, w in new], np.float64))
            index.update(zip(new, range(at, end)))
            found = [index[x] for x in terms]
        return np.array(found)

    def slots_of(self, data: bytes) -> np.ndarray:
        """The codes of a UTF-8 text; blocks of terms bound the memory, and the least of all blocks wins."""
        terms = list(Counter(data.lower().split()).items())
        best = np.full(self.slots, np.inf, np.float32)
        term, level = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int64)
        every = np.arange(self.slots)
        for at in range(0, len(terms), 4096):
            rows = self.rows(terms[at : at + 4096])
            values = self.value[rows]
            least = values.argmin(axis=0)
            value, row = values[least, every], rows[least]
            better = value < best
            best[better], term[better], level[better] = value[better], self.hash[row][better], self.level[row, every][better]
        if not terms:
            return np.zeros(self.slots, np.uint16)
        mixed = _mix(term + level.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        return np.maximum(mixed, np.uint64(1)).astype(np.uint16)

    @staticmethod
    def shown(code: np.ndarray) -> str:
        return code.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal slots."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_rows(docs: DataFrame, *, slots: int = 64, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row; null texts count as empty, equal texts have equal fingerprints."""
    from vecloom.llm.common import map_batches, utf8

    def run(batch: pa.RecordBatch) -> dict:
        tool = _sampler(slots, seed)
        return {"doc_id": batch.column("doc_id"), "fingerprint": [tool.shown(tool.slots_of(x)) for x in utf8(batch, "text")]}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, fingerprint string")


_SAMPLERS: dict[tuple[int, int], Sampler] = {}


def _sampler(slots: int, seed: int) -> Sampler:
    if (slots, seed) not in _SAMPLERS:
        _SAMPLERS[slots, seed] = Sampler(slots, seed)
    return _SAMPLERS[slots, seed]


def in_sequence(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents dealt to buckets of neighbours by descending id, each bucket followed by the next one's first.

    Columns bucket, ahead, doc_id, text, tie, sorted within the partitions; ahead marks the row that only
    follows. The next after the last document is the first. Null ids come last, rows of one id in the order
    of their texts' hashes. One shuffle moves each text once, and one text for each bucket twice.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = min(BUCKETS_EACH * parts, MAX_BUCKETS)
    bounds = rows.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], F.lit(10 * n))).first()[0] or []
    cuts = -np.unique(np.array(bounds, np.int64))[::-1]  # ascending in the order of descending ids

    @F.pandas_udf("int")
    def bucket_of(ids):
        known = ids.notna().to_numpy()
        out = np.full(len(ids), len(cuts), np.int32)
        out[known] = np.searchsorted(cuts, -ids[known].to_numpy(np.int64), side="left")
        return pd.Series(out)

    # one row a bucket: at most MAX_BUCKETS rows
    heads = rows.select("doc_id").withColumn("bucket", bucket_of("doc_id")).groupBy("bucket").agg(F.max("doc_id").alias("head")).orderBy("bucket").collect()
    order = [(r["bucket"], r["head"]) for r in heads]
    before = {b: order[i - 1][0] for i, (b, _) in enumerate(order)}
    table = spark.createDataFrame([(b, h, before[b]) for b, h in order], "bucket int, head long, before int")
    dealt = rows.withColumn("bucket", bucket_of("doc_id")).join(F.broadcast(table), "bucket")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ahead"))
    copy = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("ahead"))
    places = F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(own, copy)).otherwise(F.array(own))
    dealt = dealt.select("doc_id", "text", F.explode(places).alias("place")).select("place.bucket", "place.ahead", "doc_id", "text", F.xxhash64("text").alias("tie"))
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "ahead", F.col("doc_id").desc_nulls_last(), "tie")


def compare_edited(docs: DataFrame, *, slots: int = 64, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends in the next document's beginning (see ``edited``; next by descending id, the first
    after the last). Null texts are empty; a text without words has the all-zero fingerprint, which is like
    itself only. Rows are streamed: Python holds a batch and one text more; texts are read whole. Rows of one id
    follow each other in the order of their texts' hashes, repeated rows too; a table of one row is followed by
    itself, an empty one gives an empty result. Ids are whole numbers; other columns are dropped.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    schema = to_arrow_schema(kind)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, out, held = _sampler(slots, seed), [], None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    text = row["text"]
                    code = tool.slots_of(text.encode())
                    if held is not None and held[0] == row["bucket"]:
                        _, doc_id, before, own = held
                        changed = edited(before, text).encode()
                        other = tool.slots_of(changed)
                        out.append((doc_id, len(before), hashlib.sha256(changed).hexdigest(), tool.shown(own), tool.shown(other), likeness(own, other), likeness(own, code)))
                    # rows that repeat the head's id are all copied: only the first of them follows
                    held = None if row["ahead"] else (row["bucket"], row["doc_id"], text, code)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                    out = []

    return in_sequence(docs, id_col=id_col, text_col=text_col).mapInArrow(run, kind)


def query(spark, sf_dir: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
