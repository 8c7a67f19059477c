"""Repairs against all audits tried one by one, and long conversations against short ones."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from vecloom.llm import conversations as cv

SAID = re.compile(r"[^\x20\x09-\x0D]")
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def outcome(rows, fault, audit):
    """(cost, lines) of an audit, or None if it isn't one of these rows or leaves what the grammar doesn't allow."""
    cost, at, lines = 0, 0, []
    for edit in audit:
        if edit == "I":
            cost += 5
            lines.append((None, ""))
            continue
        if at == len(rows):
            return None
        (role, text), f = rows[at], fault[at]
        at += 1
        if edit == "D":
            cost += 2
        elif f in ("blank", "duplicate"):
            return None
        else:
            cost += (edit == "R") + 5 * (f == "truncated")
            lines.append((role if edit == "K" else None, text))
    if at < len(rows):
        return None
    headed = bool(lines) and (lines[0][0] or "")[:1] == "s"
    body = lines[headed:]
    if len(body) % 2 or (headed and not body):
        return None
    for i, (role, _) in enumerate(body):
        if role is not None and role[:1] != "ua"[i % 2]:
            return None
    wanted = [("user", "assistant")[i % 2] for i in range(len(body))]
    return cost, lines[:headed] + [(role or w, text) for (role, text), w in zip(body, wanted)]


def by_hand(turns):
    """turns: (turn, role, text) after damage, in any order."""
    turns = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    rows = [(role, text) for _, role, text in turns]
    fault = []
    for i, (role, text) in enumerate(rows):
        said = SAID.findall(text)
        fault.append("blank" if not said else "duplicate" if (role, text) in rows[:i] else "" if said[-1] in ".!?" else "truncated")
    best = None
    for inserted in range(3):
        for n in (len(rows) + inserted,):
            for audit in map("".join, product("DIKR", repeat=n)):
                if audit.count("I") == inserted and (best is None or 5 * inserted <= best[0]):
                    found = outcome(rows, fault, audit)
                    if found and (best is None or (found[0], audit) < best[:2]):
                        best = (found[0], audit, found[1])
    there = {t for t, _, _ in turns if t is not None}
    pairs = [a[:1] + b[:1] for (a, _), (b, _) in zip(rows, rows[1:])]
    lines = "\n".join(f"{r}:{t}" for r, t in best[2])
    return (
        max(there) - min(there) + 1 - len(there) if there else 0,
        *[fault.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(p not in ("su", "ua", "au") for p in pairs),
        best[0],
        best[1],
        hashlib.sha256(lines.encode()).hexdigest(),
    )


def spoiled(rows):
    """The contract's damage: {conv_id: [(turn, role, text)]}."""
    show = lambda v: " " if v is None else str(v)
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = show(role), show(text)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def as_dict(df):
    rows = df.select("conv_id", *NAMES).collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_by_hand(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = as_dict(cv.query(spark, sf_dir))
    want = spoiled([tuple(r) for r in rows])
    assert set(got) == set(want)
    for conv, turns in want.items():
        if len(turns) <= 7:
            assert got[conv] == by_hand(turns), conv


def random_turns(seed, n):
    rng = random.Random(seed)
    texts = ["One.", "Two!", "cut off", "", " \t", "Three?", " ", "One."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "usher"]
    return [(rng.choice([None, *range(n)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_random_conversations():
    for seed in range(300):
        turns = random_turns(seed, seed % 6)
        ordered = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        got = cv.one(ordered)
        assert tuple(got[n] for n in NAMES) == by_hand(turns), turns


def test_segments_join_to_the_whole():
    """The least way through a whole conversation is that of its parts, wherever it is cut."""
    for seed in range(300):
        rng = random.Random(seed)
        codes = "".join(rng.choice("suaxSUAX-uaua") for _ in range(rng.randrange(40)))
        cuts = sorted(rng.randrange(len(codes) + 1) for _ in range(rng.randrange(6)))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        tables = [{s: cv.search(p, s, (0, 1, 2, 3), first=False) for s in range(4)} for p in parts]
        ends = cv.joined(tables)[0]
        assert min(ends[e] for e in cv.ACCEPTING if e in ends) == next(iter(cv.search(codes).values()))


ODD = [
    (1, None, "user", "A question?"), (1, 1, None, "No role."), (1, 2, "assistant", None), (1, 2, "assistant", "Yes."), (1, 2, "assistant", "Yes."),
    (2, None, None, None), (2, None, None, None), (None, 5, "user", "Nobody's."), (None, 6, "assistant", "conversation"), (3, 9, "", "Empty role."),
    (4, 0, "system", "Only a system."), (5, 0, "assistant", "Starts late."), (5, 3, "user", " ."), (6, -3, "user", "lorem ipsum. " * 50_000), (6, 4, "assistant", "Long."),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def odd(spark):
    clashes = ["pos", "own", "digest", "copies", "seg", "rows", "audit", "cost", "long_id", "c", "p", "line", "damage"]
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("clash") for c in clashes})


def test_odd_input(spark):
    """Nulls in all columns, repeated rows, ties, gaps, one very long text, clashing names; with and without the damage."""
    plain = {}
    for conv, turn, role, text in ODD:
        plain.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert as_dict(cv.repair(odd(spark).drop("copies"))) == {k: by_hand(v) for k, v in plain.items()}
    assert as_dict(cv.repair(cv.damaged(odd(spark)), "copies")) == {k: by_hand(v) for k, v in spoiled(ODD).items()}


def test_all_rows_dropped(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    got = as_dict(cv.repair(cv.damaged(spark.createDataFrame([(9, turn, "user", "Hi.")], SCHEMA)), "copies"))
    assert got == {9: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_empty_table(spark):
    assert cv.repair(cv.damaged(spark.createDataFrame([], SCHEMA)), "copies").count() == 0


@pytest.mark.parametrize("segment,fan", [(2, 2), (5, 3)])
def test_long_conversations_equal_short_ones(spark, monkeypatch, segment, fan):
    """With small segments nearly all conversations are numbered, searched and joined in parts: the same rows."""
    rows = [(seed, turn, role, text) for seed in range(12) for turn, role, text in random_turns(seed, 4 + 5 * seed)] + [r for r in ODD if r[0] != 6]
    df = spark.createDataFrame(rows, SCHEMA)
    short = as_dict(cv.repair(cv.damaged(df), "copies"))
    monkeypatch.setattr(cv, "SEGMENT", segment)
    monkeypatch.setattr(cv, "FAN", fan)
    assert as_dict(cv.repair(cv.damaged(df), "copies")) == short


def test_a_long_text_alone_takes_the_long_way(spark, monkeypatch):
    df = odd(spark).drop("copies")
    short = as_dict(cv.repair(df))
    monkeypatch.setattr(cv, "HELD_BYTES", 100_000)
    assert as_dict(cv.repair(df)) == short
