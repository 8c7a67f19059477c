"""Mixing sources to target weights.

Documents get hash-random keys. Within a source they are dealt to equal-width key ranges (as many ranges
as a range has rows, about), a window gives each row the words before it in its range, and the prefix sums
of the small table of ranges give the words before the range. Each source is cut at its exact budget, after
as many whole epochs as the budget holds. Only ids, keys and sizes are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.durable import broadcast_if_small, materialize
from vecloom.llm.common import WORD

KEY_BITS = 60
#: Tables of one row a source or a range are broadcast up to this many rows (some MB), else joined by shuffle.
MAX_BROADCAST_ROWS = 100_000


def word_count(text: Column) -> Column:
    """Number of words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: int) -> Column:
    """The first 60 bits of md5("seed:id"), the same in every run."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Adds ``target`` (double) to a table of one row a source (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn. They share ``share`` times all sizes by
    weight; none gets more than ``most`` times its size, what exceeds it goes to the others by weight.
    In order of size/weight the limited sources come first, so one pass of running sums finds the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight)
    ranked = ranked.withColumn("limit", F.col("source_size") * float(most))
    ranked = ranked.withColumn("ratio", F.col("limit") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level)
    common = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(everything)
    ranked = ranked.withColumn("common", common["level"])
    share_of = F.when(F.col("common").isNull() | (F.col("ratio") < F.col("common")), F.col("limit")).otherwise(F.col("common") * F.col("weight"))
    return ranked.select("source", "source_size", "n_docs", share_of.alias("target"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: int = 7,
) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, epochs, before, taken.

    ``taken`` is the number of its words in the mix: ``epochs`` whole copies, and of the rest of the budget
    what falls to this document in key order. The document at the cut gives only its first words, so the
    words taken from a source are its target rounded to a whole number.

    Null and empty texts have size 0 and are taken 0 words; a null source is a source of its own, the last.
    Repeated rows are mixed as rows of their own; rows equal in id and size are interchangeable. An empty
    table gives an empty result. Other columns are not looked at. Needs ``most`` >= 1 and positive weights.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), random_key(F.col(id_col), seed).alias("key")
    )
    rows = materialize(rows, "mix-sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    plan = targets(totals, weights, share, most)
    plan = plan.withColumn("budget", F.floor(F.col("target") + 0.5))
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    plan = plan.withColumn("ranges", F.ceil(F.sqrt(F.col("n_docs").cast("double"))).cast("long"))
    plan = materialize(plan, "mix-targets")

    dealt = rows.alias("r").join(broadcast_if_small(plan, MAX_BROADCAST_ROWS).alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    # key / 2^60 * ranges, in whole numbers: the key's first 24 bits are enough for the range
    dealt = dealt.select("r.*", "source_size", "target", "epochs", "rest", F.shiftright(F.shiftright("key", KEY_BITS - 24) * F.col("ranges"), 24).alias("range"))
    sums = dealt.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(sums.select("source", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("offset")), "mix-offsets")

    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = summed.alias("d").join(
        broadcast_if_small(offsets, MAX_BROADCAST_ROWS).alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.range") == F.col("o.range"))
    )
    before = F.col("inner") + F.col("offset")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - before))
    return placed.select(
        "d.doc_id", "d.source", "d.size", "d.source_size", "d.target", "d.epochs", before.alias("before"), (F.col("epochs") * F.col("size") + part).alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, columns unchanged: each row as often as its words were taken, rounded to whole copies.

    A document of no words (null, empty) stays as often as its source has epochs, at least once. Rows equal in id,
    source and size, repeated ones too, share their copies: each takes the mean, rounded up. A null source is a
    source; texts of any length are whole; an empty table gives an empty one; other columns are handed on whatever
    their names.
    """
    id_col = options.get("id_col", "doc_id")
    plan = mix(docs, **options)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.greatest(F.col("epochs"), F.lit(1))).cast("int")
    # rows equal in id, source and size share their copies: each takes the mean, rounded up
    plan = plan.groupBy("doc_id", "source", "size").agg(F.ceil(F.avg(copies)).cast("int").alias("times")).filter("times > 0")
    plan = materialize(plan, "mix-copies")
    source_col, text_col = options.get("source_col", "source"), options.get("text_col", "text")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row")).select("row", word_count(F.col("row")[text_col]).alias("n_words"))
    row = F.col("d.row")
    same = row[id_col].eqNullSafe(F.col("p.doc_id")) & row[source_col].eqNullSafe(F.col("p.source")) & (F.col("d.n_words") == F.col("p.size"))
    # one plan at every size: the table of copies has a row for nearly every document
    joined = rows.alias("d").join(plan.hint("merge").alias("p"), same)
    return joined.select("d.row", F.explode(F.sequence(F.lit(1), F.col("p.times")))).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
r AS (SELECT *, source_size * 2.0::DOUBLE AS lim, source_size * 2.0::DOUBLE / weight AS ratio FROM w),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(lim) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
c AS (SELECT (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, level LIMIT 1) AS common),
t AS (SELECT source, source_size, CASE WHEN common IS NULL OR ratio < common THEN lim ELSE common * weight END AS target FROM l, c),
b AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs
  FROM t),
p AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM p
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
