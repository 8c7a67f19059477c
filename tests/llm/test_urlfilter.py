from __future__ import annotations

import random
import time

from vecloom.llm import urlfilter as uf

URLS = [
    None, "", "no scheme", "http://example.net/en/1", "http://example.net/de/1", "HTTP://WWW.Example.NET/en/", "http://example.net", "http://example.net?x=/en/", "http://notexample.net/en/",
    "http://net/", "http://net", "http://a.net/#f", "http://example.com/de/x", "http://example.com/DE/x", "http://b.example.com/de", "http://x.org/fr/", "http://org/fr/a?b", "http://x.org/fr",
    "http://ÄB.net/", "http://user@example.net:80/en/", "http://.net/", "http://example.net./en/", "a://b://example.net/en/", "://net/x", "http:///en/", "http://ex\nample.net/\nen/?x", "x" * 5000 + "://net/" + "y" * 5000,
]


def brute(url, rules):
    rest = (url or "").split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.key), len(r.host)), default=None)
    return host, path, best.key if best else None, best.verdict if best else "allow"


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "key", "rule", "verdict") for i, u in enumerate(urls)], "page_id long, url string, key string, rule string, host string")
    got = {r["page_id"]: tuple(r)[1:] for r in uf.judge(pages, rules).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_odd_urls(spark):
    check(spark, URLS + URLS[:4], uf.RULES)


def test_random_rules_and_urls(spark):
    rng = random.Random(1)
    hosts = [".".join(rng.choices("abcde", k=rng.randint(1, 4))) for _ in range(60)]
    paths = ["/", "/a/", "/a/b/", "", "/b", "/ab"]
    rules = [uf.Rule(*key, rng.choice(["allow", "block"])) for key in sorted({(rng.choice(hosts), rng.choice(paths)) for _ in range(80)})]
    rules = list({r.key: r for r in rules}.values())
    urls = [f"http://{rng.choice(['', 'x.', 'a.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'z', '?q'])}" for _ in range(500)]
    check(spark, urls, rules)


def test_many_rules_of_many_shapes(spark):
    """20,000 rules of over 100 shapes are planned in seconds and judged like any others."""
    rng = random.Random(3)
    keys = {(".".join(f"h{rng.randint(0, 999)}" for _ in range(rng.randint(1, 4))), "/" + "x" * rng.randint(0, 30)) for _ in range(20_500)}
    rules = [uf.Rule(h, p, rng.choice(["allow", "block"])) for h, p in sorted(keys)][:20_000]
    assert len({r.shape for r in rules}) > 100
    urls = [f"http://{rng.choice(['', 'a.'])}{r.host}{r.path}{rng.choice(['', 'x', '/y'])}" for r in rng.sample(rules, 150)] + [f"http://h{i}.net/x" for i in range(50)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    frame = uf.judge(pages, rules)
    began = time.perf_counter()
    frame._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - began < 20
    by_host = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)
    near = lambda u: [r for i in range(9) for r in by_host.get(".".join(u.split("://")[1].split("/")[0].split(".")[i:]), [])]
    assert {r["page_id"]: tuple(r)[1:] for r in frame.collect()} == {i: brute(u, near(u)) for i, u in enumerate(urls)}


def test_no_rules_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert uf.judge(pages, []).first()["verdict"] == "allow"
    assert uf.judge(pages.filter("false"), uf.RULES).count() == 0


def test_cascade_is_exact_and_small(spark):
    listed = spark.range(0, 300).selectExpr("concat('k', id) AS key")
    universe = spark.range(0, 20000).selectExpr("concat('k', id) AS key")
    cascade = uf.Cascade.build(listed, universe)
    got = {r["key"] for r in universe.filter(cascade.member(universe.key)).collect()}
    assert got == {f"k{i}" for i in range(300)}
    assert len(cascade.levels) > 1 and sum(level.bits for level in cascade.levels) < 300 * 20


def test_repeated_rows(spark):
    """Rows that repeat an id, a url or both are judged one by one; null ids too."""
    from collections import Counter

    rows = [(1, URLS[3]), (1, URLS[3]), (1, URLS[4]), (2, URLS[3]), (None, URLS[12]), (None, URLS[12]), (None, None), (2, None)]
    got = Counter(tuple(r) for r in uf.judge(spark.createDataFrame(rows, "page_id long, url string"), uf.RULES).collect())
    assert got == Counter((i, *brute(u, uf.RULES)) for i, u in rows)
