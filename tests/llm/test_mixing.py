from __future__ import annotations

import re
from collections import Counter

from vecloom.llm.mixing import mix, mixed_documents


def water(totals: dict, weights=(5, 2, 1), share=1.5, most=2) -> dict:
    """Targets by the contract's words: share by weight, stop at the limit, share the excess again."""
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(totals.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * totals[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = most * totals[s]
            left -= out[s]
        open_ -= over
    return out


def words(text) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    totals = Counter()
    for r in rows:
        totals[r["source"]] += words(r["text"])
    got = mix(docs).collect()
    assert len(got) == len(rows)
    want = water(dict(totals))
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == totals[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, r["target"])
        taken[r["source"]] += r["taken"]
    for s in totals:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6


def test_budgets_are_met(docs):
    check(docs)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert mix(no_docs).count() == 0 and mixed_documents(no_docs).count() == 0


def test_reruns_and_partitions_agree(docs):
    a = sorted(mix(docs).select("doc_id", "taken").collect())
    assert a == sorted(mix(docs.repartition(7)).select("doc_id", "taken").collect())


def test_order_is_by_key_within_the_source(docs):
    """Documents are whole up to the cut, one is cut, and none after it is taken."""
    by_source = {}
    for r in mix(docs).collect():
        by_source.setdefault(r["source"], []).append(r)
    for rows in by_source.values():
        extra = [r["taken"] - r["epochs"] * r["size"] for r in sorted(rows, key=lambda r: (r["before"], r["size"]))]
        sizes = [r["size"] for r in sorted(rows, key=lambda r: (r["before"], r["size"]))]
        whole = [e == s for e, s in zip(extra, sizes)]
        cut = whole.index(False) if False in whole else len(whole)
        assert not any(extra[cut + 1 :])


def test_one_source_takes_everything(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 5), "only") for i in range(200)], "doc_id long, text string, source string")
    rows = mix(docs).collect()
    assert sum(r["taken"] for r in rows) == round(1.5 * sum(r["size"] for r in rows))


def test_documents_keep_their_columns(docs):
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    plan = {r["doc_id"]: r for r in mix(docs).collect()}
    count = Counter(r["doc_id"] for r in out.collect())
    for i, r in plan.items():
        if r["size"]:
            assert count[i] == int(r["taken"] / r["size"] + 0.5)


def test_no_words_at_all(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mix(docs).collect()] == [0, 0]
    assert mixed_documents(docs).count() == 2
