"""Alignment against a naive version, and pages of several kinds of sites whose articles are known."""

from __future__ import annotations

import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from vecloom.llm import dom
from vecloom.llm import extraction as ex

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def naive_weight(a, b) -> int:
    """Simple tree matching as it is defined."""
    if a.tag != b.tag:
        return 0
    if a.tag == "#":
        return 1 + (a.token == b.token)
    left, right = [c for c in a.children if not dom.blank(c)], [c for c in b.children if not dom.blank(c)]

    @lru_cache(None)
    def table(i, j):
        return 0 if not i or not j else max(table(i - 1, j), table(i, j - 1), table(i - 1, j - 1) + naive_weight(left[i - 1], right[j - 1]))

    return 1 + (a.names == b.names) + table(len(left), len(right))


def paths(node, above=()):
    """All paths from a root to an element."""
    yield [*above, node]
    for c in node.children:
        if c.tag != "#":
            yield from paths(c, (*above, node))


def random_html(rng, depth=0) -> str:
    out = ""
    for _ in range(rng.randrange(1, 4)):
        tag = rng.choice(["div", "p", "ul", "b", "#", "#"]) if depth < 3 else "#"
        out += rng.choice(WORDS[:4]) + " " if tag == "#" else f"<{tag}{rng.choice(['', ' class=x'])}>{random_html(rng, depth + 1)}</{tag}>"
    return out


@pytest.mark.parametrize("held", [dom.CELLS_HELD, 2])
def test_alignment_is_simple_tree_matching(monkeypatch, held):
    """Also with tables that are halved until they are small."""
    monkeypatch.setattr(dom, "CELLS_HELD", held)
    for seed in range(150):
        rng = random.Random(seed)
        a, b = dom.parse(random_html(rng)), dom.parse(random_html(rng))
        assert dom.weight(a, b, {}) == naive_weight(a, b), seed
        pairs = dom.align(a, b)
        nodes = {}

        def number(n):
            nodes[n.index] = n
            for c in n.children:
                number(c)

        number(a)
        got = sum(1 + (nodes[i].token == m.token if m.tag == "#" else nodes[i].names == m.names) for i, m in pairs.items())
        assert got == naive_weight(a, b), seed
        for path in paths(b):
            place = dom.counterpart(a, path)
            stands = [i for i, m in pairs.items() if m is path[-1]]
            assert [place.index] == stands if place else not stands


def test_long_lists_align():
    """Beyond the size at which rows are arrays: every second item is gone."""
    a = dom.parse("".join(f"<p>{i}</p>" for i in range(200)))
    b = dom.parse("".join(f"<p>{i}</p>" for i in range(0, 200, 2)))
    texts = {n.children[0].text for n in a.children}
    assert len(texts) == 200
    pairs = dom.align(a, b)
    assert all(pairs[n.children[0].index].text == n.children[0].text for n in a.children if int(n.children[0].text) % 2 == 0)


def test_skeletons():
    """A skeleton's tree is the page's but for the texts."""
    for seed in range(50):
        tree = dom.parse("<body id=B class='x  y' role=Main>" + random_html(random.Random(seed)))
        again = dom.from_skeleton(dom.skeleton(tree))
        assert dom.skeleton(again) == dom.skeleton(tree)
        assert again.key == tree.key and [n.apart for n in dom.walk(again)] == [n.apart for n in dom.walk(tree)]
        assert dom.weight(again, tree, {}) == tree.full


def text_of(html: str) -> str:
    return "\n".join(b.text for b in dom.blocks(dom.parse(html)) if b.main)


@pytest.mark.parametrize(
    "html,text",
    [
        ("", ""),
        ("no markup &amp; a  reference&nbsp;&lt;3", "no markup & a reference <3"),
        ("<p>one<p>two<br>three<div>four</div>five", "one\ntwo three\nfour\nfive"),
        ("<p><b>bold<br><p>next</p> tail", "bold\nnext\ntail"),
        ("<p>a<i> b</i><b>c </b>d</p>", "a bc d"),
        ("<ul><li>one<li>two <a href=x>link</a></ul>", "one\ntwo link"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<article><h1>T</h1><script>var t='</p>'</script><p>x</p><aside>no</aside></article><p>outside</p>", "T\nx"),
        ("<body class=with-sidebar><div class=ad-slot>no</div><div class=sidebar>no</div><div id=content>yes</div><footer>no", "yes"),
        ("<header>site</header><article><header><h1>T</h1></header><p>x</p><div class=comments><p>no</p></div></article>", "T\nx"),
        ("<div class=header><p>site</p></div><main><form><p>no</p></form><p>x</p></main>", "x"),
        ("<div role=banner>no</div><div role=main>x<style>p{}</style><!-- c --></div>", "x"),
        ("<ul><li><a href=1>a</a><li><a href=2>b</a></ul><p>x <a href=3>y</a></p>", "x y"),
        ("<p>cut <b", "cut"),
        ("</div></p>stray</article> ends", "stray ends"),
        ("a < b & c <> </> d <!-- > <p> --> e<!--> f <?php > g", "a < b & c <> d e f g"),
        ("<p title='a > b' class=\"x\" >in quotes</p><p title='open>never closed</p>", "in quotes\nnever closed"),
        ("<TITLE>a <b>c</TITLE><Script>x<p>y</SCRIPT >z<textarea><p>no</textarea><script>to the end <p>no", "z"),
        ("<p class='&#97;ds'>no</p><p data-class=ads>yes</p>", "yes"),
        ("<div>" * 2000 + "deep" + "</div>" * 2000 + "<p>after", "deep\nafter"),
    ],
)
def test_blocks(html, text):
    assert text_of(html) == text


def sites(seed: int = 0, pages: int = 12):
    """(page_id, url, html, text) of four kinds of sites."""
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."
    out = []
    for i in range(pages):
        title, paras = say(4), [say(rng.randrange(5, 30)) for _ in range(rng.randrange(2, 6))]
        body = "".join(f"<p>{p}</p>" for p in paras)
        text = "\n".join([title, *paras])
        menu = "".join(f"<div><a href='/{w}'>{w}</a></div>" for w in WORDS[:4])
        # nothing says what it is: the menu, the slogan and the imprint are the same on all pages
        soup = f"<body><div class=a>{menu}</div><div class=b>Our slogan says nothing</div><div class=c><div class=t>{title}</div>{body}</div><div class=d>All rights with us</div>"
        # elements say what they are, and their words vary
        marked = f"<nav><ul><li><a>{say(2)}</a><li><a>{say(2)}</a></ul></nav><div class=ad>{say(5)}</div><article><h1>{title}</h1>{body}<p>Write to us.</p><div class=comments>{say(9)}</div></article><footer>{say(6)}</footer>"
        tables = f"<table><tr><td colspan=2>The daily table</td></tr><tr><td>Home</td><td><h2>{title}</h2>{body}</td></tr><tr><td>Imprint</td></tr></table>"
        out += [
            (f"https://soup.example/{i}", soup, text),
            (f"https://marked.example/{i}", marked, text + "\nWrite to us."),
            (f"http://TABLES.example/{i}?x", tables, text),
            (f"https://one{i}.example/", marked, text + "\nWrite to us."),
        ]
    return [(i, *r) for i, r in enumerate(out)]


SCHEMA = "page_id long, url string, html string"


def as_dict(df):
    rows = df.select("page_id", "text", "n_chars").collect()
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    return {r["page_id"]: r["text"] for r in rows}


@pytest.mark.parametrize("group", [1000, 20])
def test_articles_of_sites(spark, monkeypatch, group):
    """Also when hosts are learned in several groups."""
    monkeypatch.setattr(ex, "GROUP", group)
    rows = sites(pages=12 if group > 100 else 60)
    got = as_dict(ex.extract(spark.createDataFrame([r[:3] for r in rows], SCHEMA)))
    wrong = [i for i, _, _, text in rows if got[i] != text]
    assert not wrong, (len(wrong), got[wrong[0]], rows[wrong[0]][3])


def test_reruns_and_partitions_agree(spark):
    df = spark.createDataFrame([r[:3] for r in sites(pages=20)], SCHEMA)
    assert as_dict(ex.extract(df.repartition(7))) == as_dict(ex.extract(df.coalesce(1).orderBy(F.desc("page_id"))))


def test_copies_teach_once(spark):
    """A host of copies of one page, and one where copies outnumber the rest, lose nothing."""
    rows = sites(pages=6)
    page = next(r for r in rows if "soup" in r[1])
    copies = [(1000 + i, *page[1:]) for i in range(50)]
    marked = [(2000 + i, f"https://copies.example/{i}", page[2], page[3]) for i in range(5)]
    got = as_dict(ex.extract(spark.createDataFrame([r[:3] for r in rows + copies + marked], SCHEMA)))
    assert all(got[r[0]] == r[3] for r in rows + copies)
    assert all(page[3] in got[r[0]] for r in marked)


def test_odd_input(spark):
    """Nulls in all columns, repeated rows, a very long page, no host, clashing names; ids of any type."""
    long = "<article>" + "".join(f"<p>paragraph {i} &amp; more" for i in range(20_000)) + "</article><footer>x</footer>"
    rows = [
        ("1", None, None), ("1", None, None), (None, "https://a.example/1", "<p>null id</p>"), ("2", "no scheme", "<p>x</p>"), ("3", "https://a.example/2", ""),
        ("4", "https://a.example/3", long), ("5", "https://a.example/4", "<article><p>short</p></article>"), ("6", "://", "<b>bold</b>"), ("7", "x\n://A.example/?q", "<main>m</main>"),
    ]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    df = df.withColumns({c: F.lit("clash") for c in ("host", "part", "order", "blocks", "first", "end", "big", "parts", "text", "template", "n", "h", "p")})
    got = ex.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted((r["page_id"] or "", r["text"]) for r in got.collect())
    want = [("", "null id"), ("1", ""), ("1", ""), ("2", "x"), ("3", ""), ("4", "\n".join(f"paragraph {i} & more" for i in range(20_000))), ("5", "short"), ("6", "bold"), ("7", "m")]
    assert found == want


def test_empty_table(spark):
    assert ex.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hosts(spark):
    urls = ["http://A.example/x", "a://b://c/d", "x", None, "http://h?q", "http://h#f", "http://", "l\nm://n/", "http://Ä.example"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(ex.host_of(F.col("u"))).collect()]
    assert got == ["a.example", "b:", "", "", "h", "h", "", "n", "Ä.example"]
