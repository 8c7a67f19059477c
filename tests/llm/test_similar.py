from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from vecloom.llm import similar, simhash


def brute_set(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_groups(sets, similarity=0.8):
    """The place of the first set that links of the similarity reach, for each set."""
    label = list(range(len(sets)))
    pairs = [(i, j) for i, j in combinations(range(len(sets)), 2) if jaccard(sets[i], sets[j]) >= similarity]
    while moved := [(i, j) for i, j in pairs if label[i] != label[j]]:
        for i, j in moved:
            label[i] = label[j] = min(label[i], label[j])
    return label


def groups_of(values):
    found = {}
    for place, value in enumerate(values):
        found.setdefault(value, []).append(place)
    return sorted(found.values())


def edited(words, n, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"e{rng.randint(0, 10**6)}"
    return words


def test_whole_small_table(docs):
    rows = docs.select("doc_id", "text").collect()
    want = groups_of(brute_groups([brute_set(r["text"]) for r in rows]))
    got = {r["doc_id"]: (r["group_key"], r["component_id"]) for r in similar.similar_groups(docs).collect()}
    assert groups_of(got[r["doc_id"]][0] for r in rows) == want
    for places in want:
        assert {got[rows[i]["doc_id"]][1] for i in places} == {min(rows[i]["doc_id"] for i in places)}


@pytest.mark.parametrize("block", [4096, 40])
def test_near_copies(spark, monkeypatch, block):
    """One large group of near copies, small groups and texts by themselves; with small blocks a bucket is split."""
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "PAIRS", 500 if block < 100 else 1 << 20)
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    texts = []
    large = fresh(400)
    texts += [edited(large, 4, rng) for _ in range(150)]
    for _ in range(40):
        base = fresh(rng.choice([12, 60, 300]))
        texts += [base, edited(base, max(1, len(base) // 60), rng), edited(base, len(base) // 4, rng)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_groups([brute_set(" ".join(t)) for t in texts])
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("block", [4096, 40])
def test_one_link_between_groups_that_are_nearly_linked(spark, monkeypatch, seed, block):
    """Two groups of 80 near copies, 6,399 pairs of 0.798 between them and one of 0.8006: one group."""
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "BLOCK_SHINGLES", 30_000 if block < 100 else 1 << 20)
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(600)]
    # of 596 shingles 13 words change 5 each, the last word one, and each copy's own first word one: 67, and 66 in one pair
    other = [f"o{at}" if at in range(20, 540, 40) or at == 599 else w for at, w in enumerate(base)]
    copies = lambda words: [[f"c{rng.randint(0, 10**9)}", *words[1:]] for _ in range(80)]
    left, right = copies(base), copies(other)
    right[0][0] = left[0][0]
    texts = left + right
    sets = [brute_set(" ".join(t)) for t in texts]
    assert [(i, j) for i in range(80) for j in range(80, 160) if jaccard(sets[i], sets[j]) >= 0.8] == [(0, 80)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = {r["component_id"] for r in similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


def test_all_with_all_is_exact(spark):
    """A recall of 1 finds every link, also those that prints miss."""
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([6, 9, 14, 30]))]
        texts += [base, edited(base, 1, rng), base + ["more"], ["less"] + base]
    sets = [brute_set(" ".join(t)) for t in texts]
    found = similar.similar_groups(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), recall=1.0, similarity=0.7)
    got = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == brute_groups(sets, 0.7)


@pytest.mark.parametrize("n", [10_000, 1_000_000, 10**9])
def test_recall_at_the_similarity(n):
    """Of pairs of similarity 0.8, planned for n texts, the share that segments and distance find: 0.99, which of 1,500 pairs is 0.9825 or more."""
    rng = np.random.default_rng(1)
    index = similar.plan(n, 0.8, 0.99)
    found, pairs = 0, 1500
    for _ in range(pairs):
        base = rng.integers(0, 2**63, 450, dtype=np.uint64)
        other = np.concatenate([base[:400], rng.integers(0, 2**63, 50, dtype=np.uint64)])
        a, b = (np.frombuffer(similar.long_print(x, index.words), np.uint8) for x in (base, other))
        x, y = (v.view(f"<u{index.width // 8}")[: index.segments].astype(np.int64) & ((1 << index.lead + index.rest) - 1) for v in (a, b))
        near = ((x >> index.rest) == (y >> index.rest)) & (np.bitwise_count((x ^ y) & ((1 << index.rest) - 1)) <= index.radius)
        distance = np.bitwise_count(a[: 8 * similar.CHECK_WORDS] ^ b[: 8 * similar.CHECK_WORDS]).sum(dtype=int)
        found += bool(near.any()) and distance <= index.most
    assert found / pairs >= 0.9825


def test_plans_stay_small():
    """Neither buckets nor copies of a row nor comparisons grow out of hand with the table."""
    for e in range(2, 11):
        index = similar.plan(10**e, 0.8, 0.99)
        assert 10**e / 2**index.lead <= similar.BUCKET
        assert index.segments <= 120 and index.lead + index.rest <= 32
        assert similar.ball_size(index.rest, index.radius) * 10**e / 2 ** (index.lead + index.rest) <= 4000


def test_forests_leave_no_pair_unmarked():
    rng = np.random.default_rng(4)
    n = 60
    prints = np.repeat(rng.integers(0, 2**63, (1, 4), dtype=np.uint64), n, axis=0) ^ (np.uint64(1) << rng.integers(0, 64, (n, 4), dtype=np.uint64))
    index = similar.Plan(0, 4, 1, 1, 62)
    low, bucket = rng.integers(0, 16, n), np.repeat([3, 8], n // 2)
    every = {(i, j) for i, j in combinations(range(n), 2) if bucket[i] == bucket[j] and bin(low[i] ^ low[j]).count("1") <= 1}
    pairs = lambda: similar.near_pairs(bucket, low, prints, index)
    assert {(int(i), int(j)) for a, b, _ in pairs() for i, j in zip(a, b)} == every
    i, j, left = similar.spanning_pairs(n, pairs())
    kept = set(zip(i.tolist(), j.tolist()))
    assert kept <= every and all(left[a] for a, _ in every - kept)
    # the forest joins what all pairs join, and each tree has one top
    label = list(range(n))
    while moved := [(a, b) for a, b in every if label[a] != label[b]]:
        for a, b in moved:
            label[a] = label[b] = min(label[a], label[b])
    assert similar.tops(n, i, j).tolist() == label


@pytest.mark.parametrize("similarity", [0.5, 0.8, 1.0])
def test_clusters_are_searched_exactly(similarity):
    """Of random sets, similar ones among them, links join what brute force joins."""
    for seed in range(40):
        rng = np.random.default_rng(seed)
        sets = []
        for _ in range(6):
            base = rng.integers(0, 80, rng.integers(1, 30))
            sets += [np.unique(np.concatenate([base[: len(base) - rng.integers(0, 3)], rng.integers(0, 80, rng.integers(0, 3))])).astype(np.uint64) for _ in range(5)]
        sets = [x for x in sets if len(x)] + [np.zeros(0, np.uint64)]
        node = np.arange(len(sets)) * 7
        links = similar.joining(node, node, sets, similarity)
        plain = [set(x.tolist()) for x in sets]
        assert all(jaccard(plain[a // 7], plain[b // 7]) >= similarity for a, b in links) and len(links) < len(sets)
        label = list(range(len(sets)))
        for a, b in links:
            x, y = label[a // 7], label[b // 7]
            label = [min(x, y) if t in (x, y) else t for t in label]
        assert groups_of(label) == groups_of(brute_groups(plain, similarity))


def test_odd_rows(odd_docs, no_docs):
    found = similar.similar_groups(odd_docs).collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], set()).add(r["group_key"])
    assert len(found) == odd_docs.count()
    # empty, null and blank texts are one group; repeated rows and equal texts too
    assert by_id[3] == by_id[4] == by_id[9] and len(by_id[2]) == 1 and by_id[8] == by_id[None]
    assert len({g for s in by_id.values() for g in s}) == 7
    assert similar.similar_groups(no_docs).count() == 0


def test_deduplicated_by_similarity(odd_docs):
    kept = simhash.deduplicated(odd_docs, similar.similar_groups(odd_docs))
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 5, 6, 7, 8]


def test_forest_is_minimal():
    rng = np.random.default_rng(2)
    a, b, d = rng.integers(0, 50, 300), rng.integers(0, 50, 300), rng.integers(0, 9, 300)
    parent = list(range(50))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    weight = 0
    for i in np.argsort(d, kind="stable"):
        if (x := find(a[i])) != (y := find(b[i])):
            parent[x], weight = y, weight + d[i]
    chosen = similar.forest(50, a, b, d)
    assert d[chosen].sum() == weight and len(chosen) == 50 - len({find(i) for i in range(50)})
