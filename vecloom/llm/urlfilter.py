"""URL rules by a cascade of Bloom filters.

A rule is a host and the start of a path. The keys of a url are its host's suffixes joined to its path's
prefixes, of the shapes (labels, path length) that occur among the rules. Level 1 of the cascade encodes
the listed keys; level 2 the keys of the corpus that level 1 takes for listed though they are not; level 3
the listed keys that level 2 takes for those; and so on until no key is left. As every key of the corpus
was looked at, membership is exact for all of them, without a join when urls are judged.

Level 1's error rate is listed/(sqrt(2)*unlisted), so each later level holds fewer keys than the list; theirs is
LATER_ERROR, which keeps the levels few. The whole cascade has about 1.44*log2(unlisted/listed) + 8 bits for each
listed key: a list of any length is judged so, its levels being literals of the plan (1 million rules: some 4 MB).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.durable import broadcast_if_small, materialize

#: Error rate of the levels after the first.
LATER_ERROR = 1 / 16
#: Lists are broadcast for the one join that finds the unlisted keys up to this many keys (some MB), else shuffled.
MAX_BROADCAST_ROWS = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path

    @property
    def shape(self) -> tuple[int, int]:
        return self.host.count(".") + 1, len(self.path)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


@dataclass(frozen=True)
class Level:
    """A Bloom filter: ``words`` holds ``bits`` bits, each key sets ``hashes`` of them."""

    number: int
    bits: int
    hashes: int
    words: tuple[int, ...]

    @staticmethod
    def positions(key: Column, number: int, bits: int, hashes: int) -> Column:
        """An array of the key's bits."""
        first, second = F.pmod(F.xxhash64(key, F.lit(2 * number)), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(2 * number + 1)), F.lit(bits))
        both = F.array(F.struct(first.alias("first"), second.alias("second")))  # a one-element array is a let
        steps = F.sequence(F.lit(0), F.lit(hashes - 1))
        return F.flatten(F.transform(both, lambda h: F.transform(steps, lambda i: F.pmod(h["first"] + h["second"] * i, F.lit(bits)))))

    @classmethod
    def build(cls, keys: DataFrame, count: int, number: int, error: float) -> Level:
        """From a frame of distinct keys; the bits are gathered as 64-bit words, at most one a set bit."""
        bits = max(64, math.ceil(-count * math.log(error) / math.log(2) ** 2 / 64) * 64)
        hashes = max(1, min(30, round(bits / max(1, count) * math.log(2))))
        set_bits = keys.select(F.explode(cls.positions(F.col("key"), number, bits, hashes)).alias("bit"))
        one = F.expr("shiftleft(1L, cast(bit % 64 as int))")
        rows = set_bits.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(one).alias("value")).collect()
        words = [0] * (bits // 64)
        for row in rows:
            words[row["word"]] = row["value"]
        return cls(number, bits, hashes, tuple(words))

    def has(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded to one literal
        is_set = lambda at: F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1
        return F.forall(self.positions(key, self.number, self.bits, self.hashes), is_set)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame) -> Cascade:
        """``listed`` and ``universe``: frames with a column key. Exact for every key of both."""
        listed = materialize(listed.select("key").distinct(), "listed")
        n_listed = listed.count()
        if n_listed == 0:
            return cls(())
        unlisted = materialize(universe.select("key").distinct().join(broadcast_if_small(listed, MAX_BROADCAST_ROWS), "key", "left_anti"), "unlisted")
        n_unlisted = unlisted.count()
        inside, outside, n = listed, unlisted, n_listed
        error = min(0.5, n_listed / (math.sqrt(2) * max(1, n_unlisted)))
        levels: list[Level] = []
        while n:
            level = Level.build(inside, n, len(levels), error)
            levels.append(level)
            wrong = materialize(outside.filter(level.has(F.col("key"))), "taken")
            inside, outside, n, error = wrong, inside, wrong.count(), LATER_ERROR
            if len(levels) > 200:
                raise RuntimeError("the levels do not separate the keys")
        return cls(tuple(levels))

    def member(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the first level that lacks it tells."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].has(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """A url's keys (length, host: less the path's length, key), one of each shape for which it has labels and path enough."""
    labels, lengths = (F.split(F.lit(",".join(str(s[i]) for s in shapes)), ",").cast("array<int>") for i in (0, 1))
    url = F.array(F.struct(host.alias("host"), path.alias("path"), F.size(F.split(host, r"\.")).alias("labels"), F.length(path).alias("length")))

    def keys(u: Column) -> Column:
        def key(n: Column, i: Column) -> Column:
            long = F.get(lengths, i)
            text = F.concat(F.call_function("substring_index", u["host"], F.lit("."), -n), F.substring(u["path"], F.lit(1), long))
            made = F.struct(F.length(text).alias("length"), (-long).alias("host"), text.alias("key"))
            return F.when((u["labels"] >= n) & (u["length"] >= long), made)

        return F.filter(F.transform(labels, key), lambda k: k.isNotNull() & (u["host"] != ""))

    return F.flatten(F.transform(url, keys))


def rule_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.key, r.verdict) for r in rules], "key string, verdict string")


def judge(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every url.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest (host and path
    together, of equals that with the longer host) wins. No fitting rule: rule is null and the verdict ``otherwise``, as the cascade says that no
    key is listed. Null and malformed urls have empty host and path and fit no rule. Repeated rows are judged
    one by one; an empty table gives an empty result; other columns are dropped. Rules' hosts are lower-case.
    """
    if len({r.key for r in rules}) != len(rules):
        raise ValueError("a rule is given twice")
    # Spark must not fold the parts of the url into each of many expressions: they are made once here
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    shapes = sorted({r.shape for r in rules})
    if not shapes:
        return parts.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    keys = candidates(F.col("host"), F.col("path"), shapes)
    universe = parts.select("host", F.substring("path", 1, max(n for _, n in shapes)).alias("path")).distinct().select(F.explode(keys).alias("key")).select("key.key")
    listed = rule_frame(pages.sparkSession, rules)
    cascade = Cascade.build(listed, universe)
    # which of the listed keys block is another membership question: its universe is the list itself
    blocking = Cascade.build(listed.filter("verdict = 'block'"), listed)
    found = F.filter(keys, lambda k: cascade.member(k["key"]))
    judged = parts.withColumn("rule", F.array_max(found)["key"])
    verdict = F.when(F.col("rule").isNull(), F.lit(otherwise)).when(blocking.member(F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]

ORACLE = r"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM r),
f AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM f
"""


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
