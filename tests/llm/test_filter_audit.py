"""The audit by counts of sets against every document sent through every order."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from vecloom.llm import filter_audit as fa

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(rows: list[tuple], labels: list[tuple]) -> dict[tuple, tuple]:
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    smallest: dict[str, int] = {}
    for i, text, _ in rows:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, lang in rows:
        x = text or ""
        w = WORDS.findall(x)
        held = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", x)) > 10 * len(x),
            "D": bool(re.search("[#$%&*|]", x)),
            "E": i is not None and smallest[x] < i,
        }
        fails.append((lang or "", held, i in good, i in toxic))
    out: dict[tuple, Counter] = {}
    shapley: Counter = Counter()
    for order in map("".join, permutations("ABCDE")):
        for part, held, is_good, is_toxic in fails:
            gone = next((at for at, f in enumerate(order, 1) if held[f]), 6)
            for at, f in enumerate(order, 1):
                got = out.setdefault((part, order, at), Counter())
                got["kept"] += gone > at
                got["removed"] += gone == at
                got["redundant"] += held[f] and gone < at
                got["unique"] += held[f] and sum(held.values()) == 1
                got["good"] += gone == at and is_good
                got["toxic"] += gone == at and is_toxic
                shapley[part, f] += gone == at
    names = ("kept", "removed", "redundant", "unique", "good", "toxic")
    return {k: (*[c[n] for n in names], shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def as_dict(df) -> dict[tuple, tuple]:
    rows = df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()
    out = {tuple(r[:3]): tuple(r[3:]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()
    got = as_dict(fa.query(spark, sf_dir))
    assert got == by_hand(docs, labels)
    assert len(got) == 600 * len({d["lang"] or "" for d in docs})


def test_odd_input(spark, odd_docs):
    """Nulls, repeated rows and ids with different langs, copies, clashing names, labels twice, null and unknown ids in labels."""
    more = [(2, "", "de"), (1, "", "en"), (20, "", None), (9, "A B", "en"), (9, "A B", "de"), (9, "A B", "de"), (10, "A B", "de"), (None, "A B", "de")]
    table = odd_docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    table = table.withColumns({c: F.lit("x") for c in ("part", "digest", "n", "good", "toxic", "a", "e", "least", "words", "is_good")})
    labels = [(1, 1, 0), (1, 0, 1), (1, None, None), (10, 1, 1), (None, 1, 1), (77, 1, 1), (9, 0, 1), (2, 1, 0), (3, None, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert as_dict(fa.audit(table, marks)) == by_hand(table.select("doc_id", "text", "lang").collect(), labels)
    none = as_dict(fa.audit(table, marks.filter("false")))
    assert not any(v[4] or v[5] for v in none.values())


def test_empty_tables(spark, no_docs):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(no_docs, marks).count() == 0


def test_every_document_fails_every_filter(spark):
    """Shapley shares are equal and the first filter takes all but the original."""
    rows = [(i, "A# A#", "en") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = as_dict(fa.audit(df, marks))
    assert got == by_hand(rows, [])
    assert got["en", "ABCDE", 1][:2] == (0, 6)
