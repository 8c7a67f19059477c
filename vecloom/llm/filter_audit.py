"""How five filters interact: what each removes in every order, by inclusion and exclusion.

Each document fails some of the filters A to E. For each of the 32 sets of filters the documents that fail all of the set
are counted (sums of products of flags); everything else follows from these counts alone, whatever the table's size:

* survivors of a set P: the sum over its subsets S of (-1)^|S| count(S);
* what only filter f removes: the sum over sets S with f of (-1)^(|S|-1) count(S);
* Shapley: the game v(P) = documents that P removes has the Harsanyi dividends (-1)^(|S|-1) count(S), and each is
  shared equally by the members of its set; over all 120 orders that is dividend * 120 / |S|.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.durable import materialize
from vecloom.llm.common import SPACE, read, spread

FILTERS = "ABCDE"
SETS = range(1 << len(FILTERS))
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: What is counted in each set of filters: all documents, those of quality 1, toxic ones.
MEASURES = ("n", "good", "toxic")


def text_flags(text: Column, words: Column) -> dict[str, Column]:
    """The filters that look at a text alone, as 0 or 1: short, repetitive, capitals, symbols."""
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    chars = F.length(text).cast("long")
    capitals = chars - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "a": (n < 100).cast("int"),
        "b": (distinct * 100 < n * 80).cast("int"),
        "c": (capitals * 100 > chars * 10).cast("int"),
        "d": text.rlike("[#$%&*|]").cast("int"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, a, b, c, d, e, n, good, toxic): documents by their flags, as signed counts.

    Texts are looked at where they stand; what moves is a digest, an id and flags. Copies: every row with an id first
    counts as one, and the rows of the smallest id of each text are then moved back (-1 as copies, +1 as originals), so
    that no row ever joins its group, however many copies a text has.
    """
    flags = text_flags(F.col("text"), F.col("words"))
    rows = spread(docs.select("doc_id", "lang", "text")).select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    rows = rows.select("doc_id", "part", F.sha2("text", 256).alias("digest"), *[c.alias(k) for k, c in flags.items()])
    # partial aggregates fold repeated rows and rows without an id before any row moves
    rows = rows.groupBy("doc_id", "part", "digest", *flags).agg(F.count(F.lit(1)).alias("n"))
    is_one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(is_one("quality"), is_one("toxic"))
    marks = marks.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("quality").alias("is_good"), F.col("toxic").alias("is_toxic"))
    # one row an id, text and part is left, so that no id is frequent in the join
    rows = rows.join(marks, "doc_id", "left").na.fill(0, ["is_good", "is_toxic"])
    rows = materialize(rows.withColumns({"good": F.col("n") * F.col("is_good"), "toxic": F.col("n") * F.col("is_toxic")}), "flags")  # used twice; texts are read once
    measured = lambda sign: [(F.col(m) * sign).cast("long").alias(m) for m in MEASURES]
    named = rows.filter("doc_id IS NOT NULL")
    # the smallest id of each text and part, then of each text: a few parts a digest
    first = named.groupBy("digest", "part", *flags).agg(F.min(F.struct("doc_id", *MEASURES)).alias("m"))
    least = first.groupBy("digest").agg(F.min("m.doc_id").alias("least"), F.collect_list(F.struct("part", *flags, "m")).alias("parts"))
    originals = least.select("least", F.explode("parts").alias("p")).filter(F.col("p.m.doc_id") == F.col("least"))
    originals = originals.select("p.part", *[f"p.{f}" for f in flags], *[f"p.m.{m}" for m in MEASURES])
    every = rows.select("part", *flags, F.col("doc_id").isNotNull().cast("int").alias("e"), *measured(1))
    move = F.explode(F.array(F.struct(F.lit(1).alias("e"), F.lit(-1).alias("sign")), F.struct(F.lit(0).alias("e"), F.lit(1).alias("sign"))))
    moved = originals.select("*", move.alias("move")).select("part", *flags, "move.e", *measured(F.col("move.sign")))
    return every.unionByName(moved)


def joint_counts(rows: DataFrame, flags: list[str]) -> DataFrame:
    """(part, n, good, toxic): for each measure an array with the count of each of the 32 sets of filters; bit i is filter i."""
    cells = rows.groupBy("part", *flags).agg(*[F.sum(m).alias(m) for m in MEASURES])  # 32 rows a part leave each task
    product = lambda s: [F.col(f) for i, f in enumerate(flags) if s >> i & 1]

    def joint(m: str, s: int) -> Column:
        value = F.col(m)
        for flag in product(s):
            value = value * flag
        return F.sum(value)

    return cells.groupBy("part").agg(*[F.array(*[joint(m, s) for s in SETS]).alias(m) for m in MEASURES])


def _over_sets(joint: Column, weight) -> Column:
    """The sum over all sets s of weight(s, |s|) * joint[s]."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(SETS) - 1)), F.lit(0).cast("long"), lambda total, s: total + weight(s, F.bit_count(s)) * F.get(joint, s))


def survivors(joint: Column, mask: Column) -> Column:
    """Documents that fail none of the filters in ``mask``."""
    return _over_sets(joint, lambda s, size: F.when(s.bitwiseAND(mask) == s, F.when(size % 2 == 0, 1).otherwise(-1)).otherwise(0))


def dividends(joint: Column, bit: Column, share=lambda size: F.lit(1)) -> Column:
    """The Harsanyi dividends of all sets with a filter, each times ``share`` of the set's size."""
    return _over_sets(joint, lambda s, size: F.when(s.bitwiseAND(bit) != 0, F.when(size % 2 == 1, share(size)).otherwise(-share(size))).otherwise(0))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part.

    Null texts are empty and null langs the part ''. An id is a copy's only if it is larger than another with the same
    text: rows that repeat an id aren't copies of each other, and a null id is neither smaller nor larger than any. A
    document is good or toxic if one of its rows in ``labels`` says so; null labels say nothing, labels of unknown ids count
    nowhere. Texts of any length are judged whole. Other columns are dropped, whatever their names. An empty table
    gives no part and no row.
    """
    flags = [f.lower() for f in FILTERS]
    counts = joint_counts(flagged(docs, labels), flags)
    orders = F.explode(F.array(*[F.lit(o) for o in ORDERS]))
    rows = counts.select("*", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = {f: F.instr("filter_order", f) for f in FILTERS}
    bits = lambda when: sum((F.when(when(place[f]), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumns({"before": bits(lambda at: at < F.col("step")), "bit": bits(lambda at: at == F.col("step"))})
    before, bit = F.col("before"), F.col("bit")
    after = before.bitwiseOR(bit)
    lost = lambda m: survivors(F.col(m), before) - survivors(F.col(m), after)
    fails = F.get("n", bit)
    return rows.select(
        "part",
        "filter_order",
        "step",
        survivors(F.col("n"), after).alias("kept"),
        lost("n").alias("removed"),
        (fails - lost("n")).alias("redundant"),
        dividends(F.col("n"), bit).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        dividends(F.col("n"), bit, lambda size: (F.lit(len(ORDERS)) / size).cast("long")).alias("shapley"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


#: Every document is sent through every order, filter by filter.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS ws, min(doc_id) OVER (PARTITION BY x) AS least FROM t),
f AS (
  SELECT doc_id, part, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * len(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * len(x),
         regexp_matches(x, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails,
         coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic
  FROM w),
l AS (SELECT unnest(string_split('A,B,C,D,E', ',')) AS s),
o AS (SELECT a.s || b.s || c.s || d.s || e.s AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.s, b.s, c.s, d.s, e.s])) = 5),
r AS (SELECT filter_order, list_position(list_transform(range(1, 6), lambda i: fails[ascii(filter_order[i]) - 64]), true) AS gone, f.* FROM f, o),
s AS (
  SELECT part, filter_order, step, filter_order[step] AS letter,
         count(*) FILTER (WHERE gone IS NULL OR gone > step) AS kept, count(*) FILTER (WHERE gone = step) AS removed,
         count(*) FILTER (WHERE gone < step AND fails[ascii(filter_order[step]) - 64]) AS redundant,
         count(*) FILTER (WHERE fails[ascii(filter_order[step]) - 64] AND len(list_filter(fails, lambda v: v)) = 1) AS unique_fails,
         count(*) FILTER (WHERE gone = step AND good) AS good_lost, count(*) FILTER (WHERE gone = step AND toxic) AS toxic_lost
  FROM r, (SELECT unnest(range(1, 6)) AS step) GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM s
"""
