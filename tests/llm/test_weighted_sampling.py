from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import xxhash

from vecloom.llm import weighted_sampling as ws


def jaccard(a: str, b: str) -> float:
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    keys = x.keys() | y.keys()
    return sum(min(x[k], y[k]) for k in keys) / max(1, sum(max(x[k], y[k]) for k in keys))


def test_collision_rate_is_generalised_jaccard():
    """Over many slots the likeness of random multisets comes within four standard errors of the exact value."""
    tool = ws.Sampler(slots=4096)
    rng = np.random.default_rng(0)
    vocabulary = [f"t{i}" for i in range(60)]
    for _ in range(12):
        a = " ".join(rng.choice(vocabulary, 80, p=None))
        b = " ".join([*a.split()[:40], *rng.choice(vocabulary, rng.integers(10, 90))])
        exact = jaccard(a, b)
        near = ws.likeness(tool.slots_of(a.encode()), tool.slots_of(b.encode()))
        assert abs(near - exact) < 4 * np.sqrt(exact * (1 - exact) / 4096) + 0.002


WORD, GOLDEN = (1 << 64) - 1, 0x9E3779B97F4A7C15


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & WORD
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & WORD
    return x ^ (x >> 31)


def scalar_slots(text, slots=64, seed=1):
    """The samples term by term and slot by slot, in double precision."""
    out = []
    counts = Counter(text.encode().lower().split())  # A-Z only
    for k in range(slots):
        best = None
        for word, n in counts.items():
            h = xxhash.xxh64_intdigest(word, 7)
            draws = []
            for i in range(3):
                x = mixed(h ^ mixed(((i * slots + k + 1) * GOLDEN + seed) & WORD))
                draws.append((((x >> 40) + 0.5) / 2**24, ((x >> 16 & 0xFFFFFF) + 0.5) / 2**24))
            r, c, b = -math.log(draws[0][0] * draws[0][1]), -math.log(draws[1][0] * draws[1][1]), draws[2][0]
            t = math.floor(math.log(n) / r + b)
            value = math.log(c) - r * (t - b) - r
            if best is None or value < best[0]:
                best = value, h, t
        out.append(max(1, mixed((best[1] + best[2] * GOLDEN) & WORD) >> 48) if best else 0)
    return out


def test_samples_by_hand(docs):
    """Single precision may turn a floor or a near tie, hardly ever."""
    tool, same = ws.Sampler(), []
    for r in docs.limit(25).collect():
        same += (np.array(scalar_slots(r["text"] or "")) == tool.slots_of((r["text"] or "").encode())).tolist()
    assert np.mean(same) > 0.998


def test_equal_texts_and_caches(monkeypatch):
    texts = [" ".join(f"w{i * j % 97}" for i in range(200)) for j in range(1, 30)]
    first = [ws.Sampler().slots_of(t.encode()).tolist() for t in texts]
    tool = ws.Sampler()
    assert [tool.slots_of(t.encode()).tolist() for t in texts] == first
    monkeypatch.setattr(ws, "CACHE", 5000)
    small = ws.Sampler()
    assert [small.slots_of(t.encode()).tolist() for t in texts + texts] == first + first


def test_blocks_of_terms_do_not_matter():
    text = " ".join(f"w{i}" for i in range(9000)).encode()
    code = ws.Sampler().slots_of(text)
    assert code.all() and np.array_equal(code, ws.Sampler().slots_of(text))
    assert not ws.Sampler().slots_of(b" \n ").any()


def brute(rows):
    """doc_id -> texts in sequence, by the contract's words; ids must be unique."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text) // 2
        out[doc] = (text, text[: len(text) - n] + after[:n], after)
    return out


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want, tool = brute(rows), ws.Sampler()
    got = ws.compare_edited(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text, changed, after = want[r["doc_id"]]
        own, other, following = (tool.slots_of(x.encode()) for x in (text, changed, after))
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == tool.shown(own) and r["edited_fingerprint"] == tool.shown(other)
        assert r["near_edited"] == ws.likeness(own, other) and r["near_next"] == ws.likeness(own, following)


def test_small_table(docs):
    check(docs.repartition(3))


def test_single_document(spark):
    check(spark.createDataFrame([(5, "only one text")], "doc_id long, text string"))


def test_ids_far_apart(spark):
    check(spark.createDataFrame([(i * i * 10**9 - 10**12, f"text {i} " * (i % 7)) for i in range(100)], "doc_id long, text string"))


def test_odd_rows(odd_docs, no_docs):
    unique = odd_docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check(unique)
    rows = ws.compare_edited(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    prints = {r["fingerprint"] for r in rows if r["doc_id"] is None or r["doc_id"] == 8}
    assert len(prints) == 1
    assert ws.compare_edited(no_docs).count() == 0
    assert ws.fingerprint_rows(odd_docs).count() == odd_docs.count()
