from __future__ import annotations

import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from vecloom.llm import langid


def test_held_out_accuracy(docs, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, ~langid.held_out())
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    rows = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows]) > 0.98


def test_held_out_column(docs):
    for r in docs.select("doc_id", langid.held_out().alias("h")).collect():
        assert r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def model(**options):
    text = {"en": "the and with that have this from they would there", "de": "der und die nicht eine sich mit dem auch werden"}
    counts = {}
    for i, lang in enumerate(sorted(text)):
        for w in text[lang].split():
            for g in langid.grams(w):
                counts.setdefault(g, [0.0, 0.0])[i] += 10
    return langid.Mixture(sorted(text), counts, **options)


def test_mixture_of_two_languages():
    m = model()
    mixed = "the and with that have this " * 3 + "der und die nicht eine sich mit dem auch werden " * 4
    lang, score, chosen = m.infer(mixed)
    assert lang == "de" and [k for k, _ in chosen] == ["de", "en"] and 0.55 < score < 0.8
    lang, score, chosen = m.infer("the and with that have this from they")
    assert lang == "en" and len(chosen) == 1 and score == 1.0


def test_expectation_maximisation_finds_the_best_shares():
    """Against a grid of shares, by likelihood."""
    m = model(rounds=500)
    p, n = np.array([[0.9, 0.1], [0.2, 0.7], [0.5, 0.4]]), np.array([5.0, 3.0, 2.0])
    share, likely = m.proportions(p, n)
    grid = max(float(n @ np.log(p @ np.array([a, 1 - a]))) for a in np.linspace(0.001, 0.999, 999))
    assert likely >= grid - 1e-3 and np.isclose(share.sum(), 1.0)


def test_no_letters():
    m = model()
    for text in ("", " \n", "123 --- ...", "²½", "\U0001f600"):
        assert m.infer(text) == ("und", 0.0, [])
    assert m.infer("x")[0] in ("de", "en")
    assert m.infer("中文")[0] in ("de", "en")


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(langid, "CACHE", 64)
    m = model()
    texts = [" ".join(f"{chr(97 + i % 26)}{chr(97 + j % 26)}er" for j in range(40)) for i in range(40)]
    fresh = [model().infer(t) for t in texts]
    assert [m.infer(t) for t in texts] == fresh and len(langid.memo(m).words) <= 64


def brute_language(model, text, rounds=15):
    """Language, score and whether it explains the text, with plain loops over words and every nested set; None without a letter."""
    words = {}
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        if any(c.isalpha() for c in w):
            for piece in langid.pieces(w):
                words[piece] = words.get(piece, 0) + 1
    if not words:
        return None
    rows = []
    for piece, times in words.items():
        logs = [sum(float(model.log_p[model.row.get(piece[i : i + 3], len(model.row))][k]) for i in range(len(piece) - 2)) for k in range(len(model.languages))]
        top = max(logs)
        rows.append((times, top, [max(math.exp(x - top), 1e-12) for x in logs]))
    total = sum(t for t, _, _ in rows)

    def em(chosen):
        share = [1 / len(chosen)] * len(chosen)
        for _ in range(rounds if len(chosen) > 1 else 0):
            new = [0.0] * len(chosen)
            for t, _, p in rows:
                mixed = sum(s * p[k] for s, k in zip(share, chosen))
                for i, k in enumerate(chosen):
                    new[i] += t * share[i] * p[k] / mixed / total
            done = max(abs(a - b) for a, b in zip(new, share)) < 1e-4
            share = new
            if done:
                break
        return share, sum(t * math.log(sum(s * p[k] for s, k in zip(share, chosen))) for t, _, p in rows)

    everything = list(range(len(model.languages)))
    order = sorted(everything, key=lambda k: -em(everything)[0][k])
    best = None
    for size in range(1, len(order) + 1):
        share, likely = em(order[:size])
        value = likely - model.penalty * (size - 1) * math.log(total + 1)
        if best is None or value > best[0]:
            best = value, size, share
    value, size, share = best
    score, k = max(zip(share, [-k for k in order[:size]]))
    letters = len({c for g in model.row for c in g})
    at_random = -3 * math.log(letters) * sum(t * (len(p) - 2) for p, t in words.items())
    return model.languages[-k], score, value + sum(t * top for t, top, _ in rows) > at_random


def test_query_by_hand(spark, sf_dir, docs):
    model = langid.fit(docs, ~langid.held_out())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = langid.query(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_language(model, texts[r["doc_id"]])
        assert r["lang_pred"] == (want[0] if want else "und") and abs(r["score"] - (want[1] if want else 0.0)) < 1e-3


def test_languages_that_show_late(spark):
    """A Chinese and a Thai text whose first forty letters are of another language."""
    rows = [(i, t * 30, lang) for i, (t, lang) in enumerate([("我们今天去学校看书", "zh"), ("วันนี้เราไปโรงเรียน", "th"), ("we go to school today ", "en")] * 4)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), docs_each=100)
    assert model.languages == ["en", "th", "zh"]
    start = "wegotoschooltoday" * 3
    assert model.infer(start)[0] == "en"
    assert model.infer(start + "我们今天去学校看书" * 40)[0] == "zh"
    assert model.infer(start + "วันนี้เราไปโรงเรียน" * 40)[0] == "th"


def test_texts_in_no_learned_language_go(spark):
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), ~langid.held_out())
    rows = spark.createDataFrame([(1, "Это совсем другой язык и другие буквы", "xx", "k"), (2, "The and that of the er in on.", None, "k")], "doc_id long, text string, lang string, found string")
    assert [tuple(r) for r in langid.documents_in_a_language(rows, model).collect()] == [(2, "The and that of the er in on.", "en", "k")]


def test_odd_rows(odd_docs, no_docs, docs):
    m = langid.fit(docs, ~langid.held_out())
    got = langid.identify(odd_docs, m).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 6, 9)} == {"und"}
    assert langid.identify(no_docs, m).count() == 0
    kept = langid.documents_in_a_language(odd_docs, m)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 4
    empty = langid.fit(no_docs, ~langid.held_out())
    assert {r["lang_pred"] for r in langid.identify(odd_docs, empty).collect()} == {"und"}


def test_long_runs_of_letters_count_whole():
    assert len(langid.grams("a" * 100)) == 100
    for n in (1, 39, 40, 41, 80, 81, 200):
        word = "".join(chr(97 + i % 26) for i in range(n))
        assert [g for p in langid.pieces(word) for g in langid.marked_grams(p)] == langid.grams(word)
        assert max(map(len, langid.pieces(word))) <= 42
    m = model()
    lang, score, chosen = m.infer("theandwiththathavethis" * 4 + "derunddienichteinesichmitdemauchwerden" * 20)
    assert lang == "de" and {k for k, _ in chosen} == {"de", "en"} and score > 0.7


def test_long_texts_teach(spark):
    """A language with long texts only is learned, and every trigram of a text is in one of its parts."""
    text = "der und die nicht eine xİx İx " * 30 + "unddasistlang" * 20
    for size in (7, 50, 1000):
        got = [g for low in range(0, len(text), size) for w in langid.marked_runs(text, low, low + size) for g in langid.marked_grams(w)]
        assert sorted(got) == sorted(g for w in langid.LETTERS.findall(text.lower()) for g in langid.grams(w))
    rows = [(i, "the and with that have this from they", "en") for i in range(40)] + [(100 + i, "der und die nicht eine sich mit dem " * 1000, "de") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.fit(docs, F.lit(True))
    assert m.languages == ["de", "en"] and m.infer("und die nicht")[0] == "de"


def test_without_a_model_letters_decide(spark, odd_docs):
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    kept = langid.documents_in_a_language(unlabelled, langid.fit(unlabelled, F.lit(True)))
    assert kept.count() == odd_docs.count() - 4


def test_fit_by_loops(spark):
    """Counts of trigrams and their smoothed logarithms by plain loops, where every part is drawn."""
    import math
    import re

    rows = [(1, "Ein Haus, ein Hund!", "de"), (2, "a house", "en"), (3, "A dog 4u", "en"), (4, None, "en"), (5, "kein Licht", None), (6, "nichts", ""), (2, "a house", "en"), (7, "held out", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.col("doc_id") != 7, min_count=2)
    counts = {}
    for i, text, lang in rows:
        if i != 7 and text and lang:
            for word in re.findall(r"[^\W\d_]+", text.lower()):
                marked = f"^{word}$"
                for at in range(len(marked) - 2):
                    counts.setdefault(lang, {}).setdefault(marked[at : at + 3], 0)
                    counts[lang][marked[at : at + 3]] += 1
    counts = {lang: {g: n for g, n in c.items() if n >= 2} for lang, c in counts.items()}
    grams = {g for c in counts.values() for g in c}
    assert model.languages == ["de", "en"] and set(model.row) == grams and grams
    for k, lang in enumerate(model.languages):
        total = sum(counts[lang].values()) + 0.5 * (len(grams) + 1)
        for g in grams:
            assert math.isclose(model.log_p[model.row[g], k], math.log((counts[lang].get(g, 0) + 0.5) / total), rel_tol=1e-5)
        assert math.isclose(model.log_p[-1, k], math.log(0.5 / total), rel_tol=1e-5)


def test_without_a_language(spark):
    """No learned language is no answer: und for every text."""
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert model.languages == [] and {r["lang_pred"] for r in langid.identify(docs, model).collect()} == {"und"}
