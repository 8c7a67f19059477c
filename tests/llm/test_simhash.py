from __future__ import annotations

import random
import re

import pytest
import xxhash

from vecloom.llm import simhash
from vecloom.llm.components import connected_components


def brute_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """id, fingerprint -> smallest id reachable over fingerprints at most 2 bits apart."""
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (_, a) in enumerate(pairs):
        for j in range(i):
            if (a ^ pairs[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(pairs))]


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    pairs = [(r["doc_id"], brute_fingerprint(r["text"])) for r in rows]
    want = sorted((str(d), f"{f:016x}", str(c)) for (d, f), c in zip(pairs, brute_components(pairs)))
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want


def test_small_table(docs):
    check(docs)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.deduplicated(no_docs).count() == 0


def test_near_copies(spark):
    """Groups whose fingerprints are a few bits apart, in chains."""
    rng = random.Random(2)
    rows = []
    for g in range(12):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
        for _ in range(6):
            words = list(words)
            words[rng.randrange(300)] = f"e{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_links_find_every_pair(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = set(base)
    for v in base:
        for bits in (1, 2, 2, 3, 4):
            w = v
            for b in rng.sample(range(64), bits):
                w ^= 1 << b
            values.add(w)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    for distance in (0, 2, 3):
        got = sorted(tuple(r) for r in simhash.links(frame, distance).collect())
        want = sorted((a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= distance)
        assert got == want
    with pytest.raises(ValueError):
        simhash.links(frame, 4)


def test_chunked_text_equals_whole(monkeypatch):
    text = (" ".join(f"w{i}" for i in range(5000))).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text.decode())
    assert simhash.fingerprint(b"One  two") == brute_fingerprint("one two")


def test_deduplicated_keeps_one_of_each_group(docs):
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    want = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(want)


def test_deduplicated_with_repeated_and_unknown_ids(odd_docs):
    kept = simhash.deduplicated(odd_docs)
    groups = {r["group_key"] for r in simhash.near_duplicates(odd_docs).collect()}
    assert kept.count() == len(groups) and kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(2) == 1 and ids.count(8) == 1 and None not in ids


def test_deduplicated_where_one_id_has_two_texts(spark):
    rows = [(5, "a b c d"), (5, "w x y z q r"), (3, "w x y z q r"), (None, "only null"), (None, "other null one"), (7, "same text"), (7, "same text")]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, (rows[i] for i in (0, 2, 3, 4, 5))))


@pytest.mark.parametrize("kind", ["chain", "star", "random", "empty", "loops"])
def test_components(spark, kind):
    rng = random.Random(4)
    edges = {
        "chain": [(i, i + 1) for i in range(70)] + [(100, 101)],
        "star": [(0, i) for i in range(1, 50)] + [(60 + i, 60) for i in range(1, 20)],
        "random": [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)],
        "empty": [],
        "loops": [(1, 1), (2, 3), (3, 2), (2, 3), (None, 2), (4, None)],
    }[kind]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in root:
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
