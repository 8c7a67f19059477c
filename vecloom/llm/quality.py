"""Quality rules as a short-circuit cascade.

The measures of a text are columns; a rule is a condition under which a document is rejected. Rules are tried in the
order of rejections for cost: a document meets no rule after the one that rejects it. Both are estimated on a sample: a
rule's selectivity is that among the rows that reach it, which the base and the rules before it have let through, so the order
is found rule by rule; its cost is what it reads, in characters and values a row. (Times say less: of five rules three
take under a millionth of a second a row, which no job's time tells from nothing.) The order never changes the verdict.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.durable import materialize
from vecloom.llm.common import SPACE, SPACES, spread


@dataclass(frozen=True)
class Rule:
    """``rejects`` is SQL over the columns of ``measured`` (text, words, n_words and the base measures)."""

    name: str
    rejects: str


#: Beyond the base: bounds wide enough for prose, tables and code in any language with spaces.
RULES = (
    Rule("mean_word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
    Rule("symbols_for_words", "n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("few_letters", r"2 * regexp_count(text, '[\\p{L}]') < word_chars"),
    Rule("few_distinct_words", "20 * size(array_distinct(words)) < n_words"),
)


def trimmed_words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed != "", F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>"))


def repeated_words(words: Column, window: int = 3) -> Column:
    """How many words stand in windows that occur twice or more in the text, the first occurrence included.

    Windows are sorted with their places, so equal ones are neighbours; the places of windows equal to a
    neighbour are sorted again, and each covers what the next one does not. Hashes only tell which texts have
    a chance: equal windows have equal hashes.
    """
    n = F.size(words)
    last = n - (window - 1)
    hashes = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(window)]))
    keyed = F.transform(
        F.sequence(F.lit(1), last), lambda i: F.struct(F.concat_ws(" ", *[F.element_at(words, i + j) for j in range(window)]).alias("w"), i.alias("i"))
    )
    ordered = F.array_sort(keyed)

    def places(a: Column) -> Column:
        m = F.size(a)
        marked = F.transform(
            F.sequence(F.lit(0), m - 1),
            lambda k: F.when(
                ((k > 0) & (F.get(a, F.greatest(k - 1, F.lit(0)))["w"] == F.get(a, k)["w"])) | ((k < m - 1) & (F.get(a, F.least(k + 1, m - 1))["w"] == F.get(a, k)["w"])),
                F.get(a, k)["i"],
            ),
        )
        return F.array_sort(F.array_compact(marked))

    def covered(p: Column) -> Column:
        following = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.array(F.lit(2**30)))
        widths = F.zip_with(p, following, lambda x, y: F.least(F.lit(window), y - x))
        return F.when(F.size(p) > 0, F.aggregate(widths, F.lit(0), lambda s, x: s + x)).otherwise(F.lit(0))

    # a one-element array is a let: what stands inside is computed once
    exact = F.element_at(F.transform(F.transform(F.array(ordered), places), covered), 1)
    chance = F.element_at(F.transform(F.array(hashes), lambda h: F.size(F.array_distinct(h)) < F.size(h)), 1)
    return F.when(n < window, F.lit(0)).when(chance, exact).otherwise(F.lit(0)).cast("long")


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, words, n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), trimmed_words(text).alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    rows = rows.select("doc_id", "text", "words", lines.alias("lines"))
    return rows.select(
        "doc_id",
        "text",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


@dataclass(frozen=True)
class Estimate:
    """``cost``: characters and values that the rule reads of a row; ``rejected``: the share of the rows that reach it."""

    rule: Rule
    cost: float
    rejected: float

    @property
    def value(self) -> float:
        return self.rejected / self.cost


def _read_by(rule: Rule, rows: DataFrame) -> Column:
    """How much a rule reads of a row: characters of texts, values and characters of lists, 1 for each number."""
    named = set(re.findall(r"\w+", re.sub(r"'[^']*'", "", rule.rejects)))
    parts = [F.lit(1)]
    for name, kind in rows.dtypes:
        if name in named:
            parts.append(F.length(name) if kind == "string" else F.size(name) + F.length(F.array_join(name, "")) if kind.startswith("array") else F.lit(1))
    return sum(parts[1:], parts[0]).cast("double")


def order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000, base: str | None = None, **columns) -> list[Estimate]:
    """The rules with their estimates on about ``sample_rows`` random rows, best first; ties keep the given order.

    ``base``: a condition (``BASE_FAILED`` by default) under which rows reach no rule. Estimated on a sample because
    only the order depends on it; every document meets the rules themselves. One job counts the sample's rows by
    which rules reject them, one row for each combination that occurs; the order is chosen from these counts.
    """
    share = sample_rows / max(1, docs.count())
    # written once: rules read the same measures again and again
    rows = materialize(measured(docs.sample(share, 1) if share < 1 else docs, **columns), "rule-sample")
    rows = rows.filter(f"NOT coalesce({base or BASE_FAILED}, false)")
    flags = F.array(*[F.coalesce(F.expr(r.rejects), F.lit(False)) for r in rules])
    reads = [_read_by(r, rows).alias(f"read{i}") for i, r in enumerate(rules)]
    found = rows.select(flags.alias("flags"), *reads).groupBy("flags").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"read{i}").alias(f"read{i}") for i in range(len(rules))])
    cells = [(r["flags"], r["n"], [r[f"read{i}"] for i in range(len(rules))]) for r in found.collect()]  # sample_rows at most
    n = sum(c[1] for c in cells)
    costs = [sum(c[2][i] for c in cells) / n if n else 1.0 for i in range(len(rules))]
    left, out = list(range(len(rules))), []
    while left:
        reach = sum(c[1] for c in cells)
        estimates = [Estimate(rules[i], costs[i], sum(c[1] for c in cells if c[0][i]) / max(1, reach)) for i in left]
        place = max(range(len(left)), key=lambda k: (estimates[k].value, -k))
        out.append(estimates[place])
        i = left.pop(place)
        cells = [c for c in cells if not c[0][i]]
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, **columns) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by.

    Null texts have no words and fail the base. Texts are read whole, a long one in the memory of its row's arrays. rejected_by names the first rule in cascade order that rejects
    (base for the base); it is null for documents that are kept. Repeated rows are judged one by one; an empty
    table gives an empty result; other columns are dropped.
    """
    ranked = order(docs, rules, **columns)
    rows = measured(spread(docs), **columns).withColumn("base_failed", F.expr(BASE_FAILED))
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for e in ranked:
        verdict = verdict.when(F.expr(e.rule.rejects), F.lit(e.rule.name))
    rows = rows.withColumn("rejected_by", verdict)
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("doc_id", *measures, "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM c, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
m AS (
  SELECT l.doc_id, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM l LEFT JOIN r ON l.doc_id = r.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR 2 * len(regexp_extract_all(t, '\p{L}')) < word_chars OR 20 * len(list_distinct(w)) < n_words) AS kept
FROM b
"""


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rejected_by")
