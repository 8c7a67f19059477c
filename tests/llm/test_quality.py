from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from vecloom.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    at = {}
    for i, w in enumerate(windows):
        at.setdefault(w, []).append(i)
    repeated = {i + j for places in at.values() if len(places) > 1 for i in places for j in range(3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated)


def check(docs):
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, tuple(r)[1:8]) for r in quality.judge(docs).collect())
    want = []
    for r in docs.select("doc_id", "text").collect():
        b = brute(r["text"])
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        want.append((r["doc_id"] if r["doc_id"] is not None else -1, (*b, failed)))
    assert [(d, (*m[:5], m[5])) for d, m in got] == sorted(want)


def test_small_table(docs):
    check(docs)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert quality.judge(no_docs).count() == 0


def test_repeated_windows(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("ab", k=n)) for n in range(12)] + [" ".join(rng.choices("abcdefg", k=80)) for _ in range(20)] + ["a b c a b c", "a a a a", "a\ta\na a", "x y", "ab c d abc d ab c d"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_order_never_changes_the_verdict(docs):
    want = sorted((r["doc_id"], r["kept"]) for r in quality.judge(docs).collect())
    assert sorted((r["doc_id"], r["kept"]) for r in quality.judge(docs, quality.RULES[::-1]).collect()) == want
    assert any(k for _, k in want) and not all(k for _, k in want)


def test_order_by_rejections_for_cost(docs):
    rules = (quality.Rule("never", "false"), quality.Rule("some", "doc_id % 3 = 0"), quality.Rule("most", "doc_id % 10 <> 0"))
    ranked = quality.order(docs, rules, sample_rows=10**6)
    assert [e.rule.name for e in ranked] == ["most", "some", "never"]
    assert [e.value for e in ranked] == sorted((e.value for e in ranked), reverse=True)
    assert 0.85 < ranked[0].rejected < 0.95 and ranked[0].cost == 2.0


def test_order_is_by_the_rows_that_reach_a_rule(spark):
    """B rejects more than C, but after A hardly any row that B rejects is left; rows that the base rejects count for no rule."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text) for i in range(100)] + [(1000 + i, "short") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rules = (
        quality.Rule("a", "doc_id < 50"),
        quality.Rule("b", "doc_id >= 3 AND doc_id < 51 AND doc_id >= 0"),
        quality.Rule("c", "doc_id >= 80 AND doc_id < 100"),
        quality.Rule("of the base's", "doc_id >= 1000 OR doc_id = 99"),
    )
    ranked = quality.order(df, rules, sample_rows=10**6)
    assert [e.rule.name for e in ranked] == ["a", "c", "b", "of the base's"]
    assert [e.rejected for e in ranked] == [50 / 100, 20 / 50, 1 / 30, 0.0]
    marginal = sorted(rules, key=lambda r: -df.filter(r.rejects).count())
    assert [r.name for r in marginal] != [e.rule.name for e in ranked]


def test_cost_is_what_a_rule_reads(spark):
    """A rule of numbers goes before one that reads the text or the words, even if that rejects twice as many."""
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(i, text) for i in range(10)], "doc_id long, text string")
    rules = (quality.Rule("text", "text LIKE '%w5%' AND doc_id < 8"), quality.Rule("words", "size(words) > 5 AND doc_id < 8"), quality.Rule("number", "doc_id % 2 = 0"))
    ranked = quality.order(df, rules, sample_rows=10**6)
    costs = {e.rule.name: e.cost for e in ranked}
    assert ranked[0].rule.name == "number"
    assert costs == {"number": 2.0, "text": 2.0 + len(text), "words": 2.0 + 60 + len(text.replace(" ", ""))}


def test_order_is_the_same_in_every_run(spark):
    """Ten runs on a table of which a sample is drawn."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    runs = {tuple((e.rule.name, e.cost, e.rejected) for e in quality.order(df, sample_rows=300)) for _ in range(10)}
    assert len(runs) == 1


def test_rejected_by_names_a_rule_that_rejects(docs):
    rows = quality.judge(docs).filter(F.col("rejected_by").isNotNull()).collect()
    assert all(r["base_failed"] == (r["rejected_by"] == "base") and not r["kept"] for r in rows)


def test_clean_prose_is_kept(spark):
    rng = random.Random(2)
    prose = " ".join(rng.choices([f"word{chr(97 + i)}" for i in range(26)] + ["the", "of", "and"], k=300))
    table = "\n".join(" | ".join(f"cell{rng.randint(0, 999)}x" for _ in range(6)) for _ in range(40))
    rows = spark.createDataFrame([(1, prose), (2, table), (3, "### $$$ " * 100)], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in quality.judge(rows).collect()} == {1: True, 2: True, 3: False}
