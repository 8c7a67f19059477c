from __future__ import annotations

import hashlib
import random
import re
from math import log

import pytest

from vecloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, kind in enumerate(PATTERNS):
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            luhn = sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
            fine = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and luhn,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


CASES = [
    "a@b.c", "a@b", "x.a@b.c.d@e.f", "a@@b.c", "@b.c", "é.a@b.c", "a@b.c@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1.1", "001.002.003.0255", "1.2.3", "4111 1111 1111 1111",
    "4111-1111-1111-1111 2", "4111  1111", "+1 (234) 555-1234", "+12", "+1 2 3", "++1 234 567 8901 x", "+1234567890123456", "mail a+b%c@d-e.f-g.h. end", "+1 (2) (", "0" * 16, "1 " * 20, "a@b.c1.2.3.4",
]


@pytest.mark.parametrize("text", CASES)
def test_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_random_texts():
    rng = random.Random(0)
    for _ in range(3000):
        text = "".join(rng.choices("a1@.+-( )\n%é09", k=rng.randint(0, 40)))
        assert pii.base_spans(text) == brute(text), text
    for _ in range(2000):
        text = "".join(rng.choices("0123456789.- +", weights=[3] * 10 + [2, 2, 2, 1], k=60))
        assert pii.base_spans(text) == brute(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "a@" * 150_000, "1." * 150_000, "+" * 300_000, "+1(" * 100_000):
        pii.base_spans(text)


def corpus(spark):
    """An address whose owner's name stands near it in different texts, and a name that is common elsewhere too."""
    rng = random.Random(1)
    fill = lambda n: " ".join(rng.choices([f"w{i}" for i in range(400)], k=n))
    rows = [f"{fill(30)} Quixano common{i % 2} wrote quix@mail.example.org {fill(30)}" for i in range(6)]
    rows += [f"{fill(40)} common{i % 2} {fill(20)}" for i in range(300)]
    rows += [f"{fill(10)} Quixano was here {fill(10)}"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")


def test_disclosing_terms(spark):
    docs = corpus(spark)
    terms = {r["term"]: r["degree"] for r in pii.disclosing_terms(docs, generalise=0.9).collect()}
    assert "quixano" in terms and "common0" not in terms and "w1" not in terms
    want = brute_disclosing([r["text"] for r in docs.collect()])
    assert terms.keys() == want.keys() and all(abs(terms[t] - want[t]) < 1e-9 for t in want)
    got = {r["doc_id"]: r for r in pii.scan(docs, generalise=0.9).collect()}
    assert got[306]["n_email"] == 0 and "term" in got[306]["spans"] and "Quixano" not in got[306]["sanitised"]
    assert "quix@mail" not in got[0]["sanitised"] and "<email>" in got[0]["sanitised"]
    assert got[100]["spans"] == ""


def brute_disclosing(texts, window=8, generalise=0.9, chance=0.01):
    """By the definition, with plain loops over whole texts."""
    near, having, where = {}, {}, {}
    for i, text in enumerate(texts):
        spans = brute(text)
        for pair in brute_contexts(text, spans, window):
            near.setdefault(pair, []).append(i)
        for name in {pii.entity(text, s) for s in spans}:
            having.setdefault(name, []).append(i)
        for term in {m.lower() for m in re.findall(r"[^\W_]+", text)}:
            where.setdefault(term, []).append(i)
    out = {}
    for (name, term), places in near.items():
        p, q, m = len(having[name]) / len(texts), min(1, len(places) / len(where[term])), len({texts[i] for i in places})
        if p < q:
            degree = log(q / p) / -log(p)
            divergence = q * log(q / p) + ((1 - q) * log((1 - q) / (1 - p)) if q < 1 else 0)
            if degree >= generalise and m / q * divergence >= log(len(near) / chance):
                out[term] = max(degree, out.get(term, 0))
    return out


def recurring(spark):
    """Entities of all frequencies, each with an owner's name beside it, with copies, and names in other texts too."""
    rng = random.Random(4)
    rows = []
    for e in range(40):
        for j in range(rng.randint(1, 9)):
            fill = [f"w{rng.randint(0, 300)}" for _ in range(40)]
            fill[20:20] = [f"Owner{e}", f"own{e}@mail.example.org", f"place{e % 5}"]
            rows += [" ".join(fill)] * rng.choice([1, 1, 1, 3])
        if e % 3 == 0:
            rows.append(f"Owner{e} and w1 w2 w3 only")
    rows += [" ".join(f"w{rng.randint(0, 300)}" for _ in range(50)) for _ in range(500)]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_degrees_by_hand(spark, docs):
    for table in (recurring(spark), docs):
        want = brute_disclosing([r["text"] or "" for r in table.collect()])
        got = {r["term"]: r["degree"] for r in pii.disclosing_terms(table).collect()}
        assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want)
    assert len(brute_disclosing([r["text"] for r in recurring(spark).collect()])) > 15


def test_two_texts_are_enough_for_a_rare_entity(spark):
    rng = random.Random(6)
    fill = lambda: " ".join(f"w{rng.randint(0, 200)}" for _ in range(30))
    rows = [fill() for _ in range(4000)] + [f"{fill()} Zorblat zor@mail.example.org {fill()}" for _ in range(2)] + [f"{fill()} Once one@mail.example.org {fill()}"] * 3
    terms = {r["term"] for r in pii.disclosing_terms(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert "zorblat" in terms and "once" not in terms and "w1" not in terms


def test_join_path_gives_the_same(spark, monkeypatch):
    docs = corpus(spark)
    want, clean = sorted(map(tuple, pii.scan(docs, generalise=0.9).collect())), sorted(pii.sanitised_documents(docs, generalise=0.9).collect())
    monkeypatch.setattr(pii, "MAX_TERMS", 0)
    assert sorted(map(tuple, pii.scan(docs, generalise=0.9).collect())) == want
    assert sorted(pii.sanitised_documents(docs, generalise=0.9).collect()) == clean


def test_join_path_for_letters_of_all_kinds(spark, monkeypatch):
    odd = ["İsmet", "ΟΔΥΣΣΕΥΣ", "Ǆ", "e\u0301clair", "x²", "ⅷ", "王伟", "ſtraße"]
    rows = [(10 * i + j, f"only{i}{j} {w} k{i}@mail.example.org {w}") for i, w in enumerate(odd) for j in range(5)] + [(100 + i, f"other words{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, clean = sorted(map(tuple, pii.scan(docs).collect())), sorted(pii.sanitised_documents(docs).collect())
    assert "term" in want[0][7]
    monkeypatch.setattr(pii, "MAX_TERMS", 0)
    assert sorted(map(tuple, pii.scan(docs).collect())) == want and sorted(pii.sanitised_documents(docs).collect()) == clean


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", "mail bob@mail.example.org"), (None, None)], "doc_id string, text string")
    assert {(r["doc_id"], r["n_email"]) for r in pii.scan(docs).collect()} == {("a", 1), (None, 0)}


def test_odd_rows(odd_docs, no_docs):
    got = pii.scan(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_text = {r["doc_id"]: (r["text"] or "") for r in odd_docs.collect()}
    for r in got:
        spans = [(a, pii.KINDS[k], b) for a, k, b in brute(by_text[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
    assert pii.scan(no_docs).count() == 0
    out = pii.sanitised_documents(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert all((r["text"] is None) == (by_text[r["doc_id"]] == "" and r["doc_id"] == 4) for r in out.collect())
    assert pii.sanitised_documents(no_docs).count() == 0


def test_overlapping_kinds_are_replaced_once():
    text = "a 1.2.3.4@b.c z"
    spans = pii.all_spans(text, {}.keys())
    assert [s[3] for s in spans] == ["email", "ip"]
    assert pii.sanitised(text, spans, {}, 1.0) == "a <email> z"


def test_defaults_find_the_planted_term(spark):
    """One document in seven with the name is without the address; clean documents stay as they are."""
    docs = corpus(spark)
    assert "quixano" in {r["term"] for r in pii.disclosing_terms(docs).collect()}
    got = {r["doc_id"]: r for r in pii.scan(docs).collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all("Quixano" not in got[i]["sanitised"] for i in before if "Quixano" in before[i])
    clean = [i for i in before if "Quixano" not in before[i] and not pii.base_spans(before[i])]
    assert len(clean) > 200 and all(got[i]["spans"] == "" and got[i]["sanitised"] == before[i] for i in clean)


def test_texts_that_grow_in_lower_case_are_searched(spark):
    """U+0130 is two code points in lower case: offsets are those of the text, and the word itself is a term like others."""
    text = "İstanbul, then Quixano and İstanbul."
    spans = pii.all_spans(text, {"quixano": 1.0, "İstanbul".lower(): 1.0}.keys())
    assert [(text[s:e], kind) for s, _, e, kind in spans] == [("İstanbul", "term"), ("Quixano", "term"), ("İstanbul", "term")]
    rows = [(i, f"word{i} İsmet wrote ism@mail.example.org here{i} İzmir") for i in range(4)] + [(i, f"İzmir other{i} words{i}") for i in range(4, 300)]
    rows.append((300, "İsmet alone"))
    got = {r["doc_id"]: r["sanitised"] for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("İsmet" not in got[i] for i in (0, 1, 2, 3, 300)) and got[100] == rows[100][1]


def brute_contexts(text, spans, window):
    free = [m for m in re.finditer(r"[^\W_]+", text) if not any(a < m.end() and m.start() < e for a, _, e in spans)]
    out = set()
    for span in spans:
        left, right = [m for m in free if m.end() <= span[0]][-window:], [m for m in free if m.start() >= span[2]][:window]
        out |= {(pii.entity(text, span), m.group().lower()) for m in left + right}
    return out


def test_contexts_are_whole():
    """Contact lists, terms far away by characters, and short names."""
    people = [f"Name{i} Li{i} n.{i}@host{i}.example.org +1 (234) 555-{1000 + i}" for i in range(60)]
    far = "Quixano" + " " * 900 + "x" * 700 + " Wu bob@mail.example.org, 王伟 " + "-" * 2000 + " Ana"
    for text in (" ".join(people), " ".join(people[:5]), far, "a 1.2.3.4@b.c z", "bob@mail.example.org", ""):
        spans = pii.base_spans(text)
        for window in (1, 2, 8):
            assert pii.contexts(text, spans, window) == brute_contexts(text, spans, window)
    terms = {t for _, t in pii.contexts(far, pii.base_spans(far), 8)}
    assert terms == {"quixano", "x" * 700, "wu", "王伟", "ana"}
    terms = {t for _, t in pii.contexts(" ".join(people), pii.base_spans(" ".join(people)), 8)}
    assert "name30" in terms and not terms & {"example", "org", "555", "host30"}
