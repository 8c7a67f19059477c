from __future__ import annotations

import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from vecloom.llm import toxicity


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter(toxicity.held_out()).collect()
    y, score = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    # ties count half
    ranks = np.array([(score < x).sum() + ((score == x).sum() + 1) / 2 for x in score])
    n1 = y.sum()
    assert (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1)) >= 0.98
    hit = np.mean([r["predicted"] == r["toxic"] for r in rows])
    caught = np.mean([r["predicted"] for r in rows if r["toxic"]])
    assert hit > 0.975 and caught > 0.85
    assert all((r["score"] >= 0.5) == bool(r["offending"]) for r in rows)
    # clean documents joined to one are clean; one offence in it is found
    clean = [r["text"] for r in rows_of(docs, [r["doc_id"] for r in rows if not r["toxic"] and r["score"] < 0.5])] * 3
    joined = "\n".join(clean[:1000])
    assert len(clean) > 1000 and model.score(joined)[0] < 0.5
    offence = next(r for r in rows if r["toxic"] and r["predicted"])
    text = next(r["text"] for r in rows_of(docs, [offence["doc_id"]]))
    score, found = model.score(joined + "\n" + text)
    assert score >= 0.5 and found and all(a >= len(joined) for a, _, _ in found)


def rows_of(docs, ids):
    return docs.filter(docs.doc_id.isin(ids)).collect()


def test_query_by_hand(spark, sf_dir, docs):
    """Every row of the query against a scalar version of the formula."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    want = {}
    for r in docs.collect():
        p = []
        for sentence in re.split(r"[.!?\n]+", r["text"] or ""):
            if sentence:
                words = set(re.findall(r"\w+", sentence.lower()))
                features = [w for w in words] + [w[:n] + "~" for w in words for n in (4, 5, 6) if len(w) >= n]
                p.append(1 / (1 + math.exp(-max(-30, min(30, model.bias + math.fsum(model.weights.get(f, 0.0) for f in features))))))
        want[r["doc_id"]] = 1 - math.prod(1 - x for x in p)
    got = toxicity.query(spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        assert math.isclose(r["score"], want[r["doc_id"]], abs_tol=1e-6) and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_long_texts_teach(spark):
    filler = "a plain line of words. " * 4000
    rows = [(i, filler + ("vile thing. " if i % 2 else "") + f"n{i}") for i in range(20)] + [(100 + i, f"short {i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 if i < 100 else 0) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert model.score("some vile thing")[0] > 0.5 and model.score(filler)[0] < 0.5


def test_noisy_or_and_places():
    model = toxicity.NoisyOr({"bad": 6.0, "worse~": 9.0}, -6.0)
    text = "All is fine. This is bad! Nothing here.\nworseness bad"
    score, found = model.score(text)
    p = [s for _, _, s in model.sentences(text)]
    assert np.isclose(score, 1 - np.prod([1 - x for x in p]))
    many = toxicity.NoisyOr({"x": 1.0}, -1.2)
    assert np.isclose(many.score("x. a. b")[0], 1 - (1 - 1 / (1 + math.exp(0.2))) * (1 - 1 / (1 + math.exp(1.2))) ** 2)
    assert many.score("a. x. b")[1] == [many.sentences("a. x. b")[1]] and many.score("a")[1] == []
    assert [text[a:b].strip() for a, b, _ in found] == ["This is bad", "worseness bad"]
    assert model.score("") == (0.0, []) and model.score("...") == (0.0, [])


def test_training_finds_the_sentence():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(50)]
    bags, labels = [], []
    for i in range(400):
        sentences = [" ".join(rng.choice(words, 6)) for _ in range(5)]
        if i % 4 == 0:
            sentences[rng.integers(5)] += " vile" + "abc"[i % 3]
        bags.append(". ".join(sentences))
        labels.append(int(i % 4 == 0))
    model = toxicity.train(bags, labels)
    got = [model.score(b) for b in bags]
    assert np.mean([(s >= 0.5) == y for (s, _), y in zip(got, labels)]) > 0.99
    for bag, label, (_, found) in zip(bags, labels, got):
        if label:
            assert any("vile" in bag[a:b] for a, b, _ in found)
    assert model.score("w1 w2. viled again")[0] > 0.5  # by the beginning of an unseen word


def plain_train(bags, labels, rounds, rate=0.1, decay=0.05, spread=50.0, min_docs=3, min_z=3.0, long_bag=1000):
    """``train`` by loops over documents, sentences and features."""

    def features(text):
        out = set()
        for w in re.findall(r"\w+", text.lower()):
            out |= {w} | {w[:n] + "~" for n in (4, 5, 6) if len(w) >= n}
        return out

    n1, n0 = sum(labels), len(labels) - sum(labels)
    shown = {f: [sum(f in features(b) for b, y in zip(bags, labels) if y == k) for k in (0, 1)] for f in set().union(*map(features, bags))}
    chosen = []
    for f, (b, a) in shown.items():
        p = (a + b) / (n0 + n1)
        if a + b >= min_docs and abs(a / n1 - b / n0) >= min_z * math.sqrt(max(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0)):
            chosen.append(f)
    params = {f: 0.5 * max(0.0, math.log((shown[f][1] + 0.5) / n1) - math.log((shown[f][0] + 0.5) / n0)) for f in chosen} | {None: -6.0}
    sentences = [[[f for w in set(re.findall(r"\w+", s.lower())) for f in [w] + [w[:n] + "~" for n in (4, 5, 6) if len(w) >= n] if f in params] for s in re.split(r"[.!?\n]+", b) if s] for b in bags]
    m, v = dict.fromkeys(params, 0.0), dict.fromkeys(params, 0.0)
    for step in range(1, rounds + 1):
        grad = {f: (decay / len(bags) * (1 + spread / max(sum(shown[f]), 1)) * x if f is not None else 0.0) for f, x in params.items()}
        for doc, y in zip(sentences, labels):
            z = [params[None] + sum(params[f] for f in fs) for fs in doc]
            s = sum(math.log1p(math.exp(x)) for x in z)
            slope = (-1 / math.expm1(s) if y else 1.0) * (n0 + n1) / (2 * (n1 if y else n0)) / len(bags)
            for x, fs in zip(z, doc):
                for f in [*fs, None]:
                    grad[f] += slope / (1 + math.exp(-x))
        for f in params:
            m[f], v[f] = 0.9 * m[f] + 0.1 * grad[f], 0.999 * v[f] + 0.001 * grad[f] ** 2
            params[f] -= rate * (m[f] / (1 - 0.9**step)) / (math.sqrt(v[f] / (1 - 0.999**step)) + 1e-8)
    z = [[params[None] + sum(params[f] for f in fs) for fs in doc] for doc in sentences]
    clean = [x for x, y in zip(z, labels) if not y and sum(math.log1p(math.exp(t)) for t in x) < math.log(2)]
    exponent = lambda a: sum(math.log1p(math.exp(a * t)) for x in clean for t in x) * long_bag / max(1, len(clean))
    factor = 1.0
    while exponent(factor) > 0.1 and factor < 64:
        factor += 0.001
    return {f: x * factor for f, x in params.items() if f is not None and abs(x) > 1e-3}, params[None] * factor


def test_training_by_loops():
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(30)]
    bags, labels = [], []
    for i in range(60):
        sentences = [" ".join(rng.choice(words, 4)) for _ in range(rng.integers(1, 5))]
        if i % 3 == 0:
            sentences[0] += " " + ["nasty", "nastier", "vile"][i % 9 // 3]
        bags.append("! ".join(sentences))
        labels.append(int(i % 3 == 0))
    for rounds in (1, 25):
        model = toxicity.train(bags, labels, rounds=rounds)
        weights, bias = plain_train(bags, labels, rounds)
        assert set(weights) == set(model.weights)
        assert all(math.isclose(model.weights[f], w, rel_tol=2e-3) for f, w in weights.items()) and math.isclose(model.bias, bias, rel_tol=2e-3)
    assert max(model.weights, key=model.weights.get).startswith(("nas", "vil"))


def test_one_class_only():
    assert toxicity.train(["a b"], [0]).score("a b")[0] < 0.01
    assert toxicity.train([], []).score("a b")[0] < 0.01


def test_labels_of_held_out_rows_do_not_matter(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (toxicity.fit(docs, x, ~toxicity.held_out()) for x in (labels, flipped))
    assert a.weights == b.weights and a.bias == b.bias
    for r in docs.select("doc_id", toxicity.held_out().alias("h")).collect():
        assert r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_odd_rows(spark, odd_docs, no_docs, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd_docs, labels, toxicity.held_out() | ~toxicity.held_out())
    got = toxicity.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.fit(no_docs, labels.filter("false"), ~toxicity.held_out()).weights == {}
