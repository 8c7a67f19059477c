"""Conversations repaired by their cheapest edits.

A conversation's turns are to say ``(s?(ua)+)?``: an optional system turn, then user and assistant in turn, or nothing at
all. Each row is kept (0), given another role (1) or deleted (2; blank and repeated rows must be), turns without text are
inserted (5), and a truncated row that stays costs 5 more. The edits are a path through a lattice of nodes (row, state of
the grammar), which is never built: Dijkstra's search makes its nodes as it meets them, takes them in the order of
(cost, audit), the audit being the edits' initials, and stops at the first accepting node behind the last row.

No two paths to one node have equal costs and audits of which one begins the other, since an audit says what its path
costs. So the least path has least parts, and a long conversation is searched in segments of bounded size: from each state
to each state in all of them at once, then the segments' tables are joined, some at a time, until one is left.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.durable import broadcast_if_small, materialize
from vecloom.llm.common import SPACES, map_batches, read, typed
from vecloom.operators.positions import with_position
from vecloom.shipping import ship

#: States of the grammar: nothing yet, after the system turn, after a user's, after an assistant's; where each initial leads.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
LEGAL = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A row in the lattice is one character: its initial (x for any other than s, u, a), in capitals if it is truncated, or this.
GONE = "-"
#: Rows of a segment at most, and tables of segments joined at a time.
SEGMENT, FAN = 256, 64
#: Bytes of a conversation that one row may hold.
HELD_BYTES = 8 << 20

Best = dict[int, tuple[int, str]]


def search(codes: str, start: int = 0, ends: tuple[int, ...] = ACCEPTING, first: bool = True) -> Best:
    """Least (cost, audit) from ``start`` before the first row to states of ``ends`` behind the last: the first met, or all."""
    heap, done, found = [(0, "", 0, start)], set(), {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(codes):
            if state in ends:
                found[state] = (cost, audit)
                if first:
                    return found
        else:
            code = codes[i]
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if code != GONE:
                own, kept = code.lower(), cost + (TRUNCATED if code.isupper() else 0)
                for initial, after in NEXT[state].items():
                    if initial == own:
                        heapq.heappush(heap, (kept, audit + "K", i + 1, after))
                    elif initial in ROLES:
                        heapq.heappush(heap, (kept + REROLE, audit + "R", i + 1, after))
        for initial, after in NEXT[state].items():
            if initial in ROLES:
                heapq.heappush(heap, (cost + INSERT, audit + "I", i, after))
    return found


def joined(tables: list[dict[int, Best]]) -> dict[int, Best]:
    """The table (from state, to state) of segments that follow each other."""
    out = {}
    for start in range(len(NEXT)):
        here: Best = {start: (0, "")}
        for table in tables:
            there: Best = {}
            for state, (cost, audit) in here.items():
                for end, (more, edits) in table[state].items():
                    way = (cost + more, audit + edits)
                    if end not in there or way < there[end]:
                        there[end] = way
            here = there
        out[start] = here
    return out


def illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


def repaired(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The (role, text) that an audit makes of a conversation's."""
    out: list[tuple[str, str]] = []
    at, state = 0, 0
    for edit in audit:
        role, text = rows[at] if edit != "I" else ("", "")
        at += edit != "I"
        if edit != "D":
            if edit != "K":
                role = ROLES[next(r for r in NEXT[state] if r in ROLES)]
            out.append((role, text))
            state = NEXT[state][role[0]]
    return out


def code_of(role: str, truncated: bool, gone: bool) -> str:
    own = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return GONE if gone else own.upper() if truncated else own


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """Each row's first fault: blank, duplicate, truncated or none of these."""
    out, seen = [], set()
    for role, text in rows:
        end = text.rstrip(SPACES)[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
        seen.add((role, text))
    return out


def _tied(text: Column) -> Column:
    """Rows of equal turn stand by role, then by this."""
    return F.sha2(text, 256)


def _clean(rows: DataFrame, copies: str | None) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    times = F.coalesce(F.col(copies), F.lit(0)).cast("int") if copies else F.lit(1)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"), times.alias("copies"))


FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """conv_id, counts of faults, cost and audit of the cheapest edits, and the digest of the repaired conversation.

    ``copies``: a column that says how many times a row stands in its place; of rows with 0 only the conversation is known.
    A conversation without rows has zeros, an empty audit and the digest of nothing. Rows stand by turn, null turns first;
    of equal turn by role, then by the SHA-256 of the text; rows that repeat entirely are duplicates. Null roles and texts
    are one space, so a null text is blank; an empty role has no initial and must be replaced or deleted. A null
    conv_id is a conversation. Other columns are dropped, whatever their names; an empty table gives an empty one.

    Conversations of up to SEGMENT rows and HELD_BYTES are one row each; longer ones are never in one place: their rows are
    numbered over all tasks and searched in segments, and what is hashed passes through a task as a stream, as a digest
    of one text must.
    """
    rows = _clean(rows, copies)
    size = (F.octet_length("role") + F.octet_length("text")).cast("long") * F.col("copies")
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(size).alias("bytes"))
    long = materialize(sizes.filter((F.col("n") > SEGMENT) | (F.col("bytes") > HELD_BYTES)).select(F.col("conv_id").alias("long_id")), "long_ids")
    if long.isEmpty():
        return repaired_short(rows)
    ids = broadcast_if_small(long, 1_000_000)
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    return repaired_short(rows.join(ids, is_long, "left_anti")).unionByName(repaired_long(rows.join(ids, is_long, "left_semi").filter("copies > 0")))


def repaired_short(rows: DataFrame) -> DataFrame:
    """``repair`` of conversations that fit in a row each."""
    standing = F.when(F.col("copies") > 0, F.struct("turn", "role", "text", "copies"))
    grouped = rows.groupBy("conv_id").agg(F.collect_list(standing).alias("rows"))
    names = [f.split()[0] for f in FOUND.split(", ")]

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in names}
        for turns in batch.column("rows").to_pylist():
            turns.sort(key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"], hashlib.sha256(r["text"].encode()).digest()))
            found = one([(r["turn"], r["role"], r["text"]) for r in turns for _ in range(r["copies"])])
            for n in names:
                out[n].append(found[n])
        return {"conv_id": batch.column("conv_id")} | out

    return map_batches(grouped, run, f"{typed(rows, 'conv_id')}, {FOUND}", rows=64)


def one(turns: list[tuple[int | None, str, str]]) -> dict:
    """What ``repair`` says of one conversation, its rows (turn, role, text) in order."""
    rows = [(role, text) for _, role, text in turns]
    fault = faults(rows)
    codes = "".join(code_of(role, f == "truncated", f in ("blank", "duplicate")) for (role, _), f in zip(rows, fault))
    ((cost, audit),) = search(codes).values()
    there = {t for t, _, _ in turns if t is not None}
    lines = "\n".join(f"{role}:{text}" for role, text in repaired(rows, audit))
    return {f: fault.count(f) for f in ("blank", "duplicate", "truncated")} | {
        "gaps": max(there) - min(there) + 1 - len(there) if there else 0,
        "illegal": sum(a[:1] + b[:1] not in LEGAL for (a, _), (b, _) in zip(rows, rows[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256(lines.encode()).hexdigest(),
    }


TABLE = "first string, last string, blank long, duplicate long, truncated long, illegal long, ways array<struct<start int, end int, cost long, audit string>>"


def numbered(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, role, digest, text_digest, own, blank, truncated, again): rows without their texts, by place.

    Equal rows are folded before they move and unfolded as slim rows, each with its number; a conversation of any
    length is dealt to many ranges.
    """
    trimmed = F.rtrim("text", F.lit(SPACES))
    own = F.substring("role", 1, 1)
    slim = rows.select(
        "conv_id",
        "turn",
        "role",
        _tied(F.col("text")).alias("text_digest"),
        F.when(own.isin("s", "u", "a"), own).otherwise("x").alias("own"),
        (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
        "copies",
    )
    folded = slim.groupBy("conv_id", "turn", "role", "text_digest", "own", "blank", "truncated").agg(F.sum("copies").cast("int").alias("copies"))
    each = folded.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copies")
    placed = with_position(each.withColumn("order", F.struct("conv_id", "turn", "role", "text_digest", "copy")), "order", "place").drop("order")
    starts = placed.groupBy("conv_id").agg(F.min("place").alias("start"))
    starts = broadcast_if_small(materialize(starts.withColumnRenamed("conv_id", "start_id"), "starts"), 1_000_000)
    placed = placed.join(starts, F.col("conv_id").eqNullSafe(F.col("start_id"))).withColumn("pos", F.col("place") - F.col("start")).drop("place", "start", "start_id")
    return materialize(placed, "numbered")


def segments(placed: DataFrame) -> DataFrame:
    """(conv_id, seg, TABLE): each segment's least ways between states, its faults and first and last initials."""
    # the first place of each text of a conversation; its key is the text's, its rows are folded before they move
    first = placed.groupBy("conv_id", "role", "text_digest").agg(F.min("pos").alias("pos")).select(F.col("conv_id").alias("c"), F.col("pos").alias("p"), F.lit(True).alias("new"))
    marked = placed.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p")), "left").withColumn("again", F.col("new").isNull())
    gone = F.col("blank") | F.col("again")
    code = F.when(gone, F.lit(GONE)).when(F.col("truncated"), F.upper("own")).otherwise(F.col("own"))
    fault = F.when(F.col("blank"), "b").when(F.col("again"), "d").when(F.col("truncated"), "t").otherwise(".")
    parts = marked.withColumn("seg", F.floor(F.col("pos") / SEGMENT)).groupBy("conv_id", "seg")
    grouped = parts.agg(F.sort_array(F.collect_list(F.struct("pos", code.alias("code"), fault.alias("fault"), "own"))).alias("rows"))  # SEGMENT rows at most

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in ("first", "last", "blank", "duplicate", "truncated", "illegal", "ways")}
        for rows in batch.column("rows").to_pylist():
            codes, found, own = ("".join(r[c] for r in rows) for c in ("code", "fault", "own"))
            table = {start: search(codes, start, tuple(range(len(NEXT))), first=False) for start in range(len(NEXT))}
            _add(out, own[0], own[-1], [found.count(c) for c in "bdt"] + [illegal(own)], table)
        return {"conv_id": batch.column("conv_id"), "seg": batch.column("seg")} | out

    return map_batches(grouped, run, f"{typed(placed, 'conv_id')}, seg long, {TABLE}", rows=16)


def _add(out: dict[str, list], first: str, last: str, counts: list[int], table: dict[int, Best]) -> None:
    ways = [{"start": s, "end": e, "cost": c, "audit": a} for s, best in table.items() for e, (c, a) in sorted(best.items())]
    for name, value in zip(out, [first, last, *counts, ways]):
        out[name].append(value)


def joined_segments(tables: DataFrame) -> DataFrame:
    """One level up: FAN neighbours become one."""
    names = [f.split()[0] for f in TABLE.split(", ")[:6]]
    grouped = tables.groupBy("conv_id", F.floor(F.col("seg") / FAN).alias("up")).agg(F.sort_array(F.collect_list(F.struct("seg", *names, "ways"))).alias("rows"))  # FAN tables at most

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in (*names, "ways")}
        for rows in batch.column("rows").to_pylist():
            each: list[dict[int, Best]] = []
            for r in rows:
                each.append({s: {} for s in range(len(NEXT))})
                for w in r["ways"]:
                    each[-1][w["start"]][w["end"]] = (w["cost"], w["audit"])
            counts = [sum(r[n] for r in rows) for n in names[2:]]
            counts[-1] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(rows, rows[1:]))
            _add(out, rows[0]["first"], rows[-1]["last"], counts, joined(each))
        return {"conv_id": batch.column("conv_id"), "seg": batch.column("up")} | out

    return map_batches(grouped, run, f"{typed(tables, 'conv_id')}, seg long, {TABLE}", rows=4)


def least_ways(placed: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) of numbered rows: segments joined level by level."""
    tables = materialize(segments(placed), "segments")
    while (tables.agg(F.max("seg")).first()[0] or 0) > 0:
        tables = materialize(joined_segments(tables), "segments")
    ends = F.filter("ways", lambda w: (w["start"] == 0) & w["end"].isin(*ACCEPTING))
    best = F.array_min(F.transform(ends, lambda w: F.struct(w["cost"].alias("cost"), w["audit"].alias("audit"))))
    return materialize(tables.select("conv_id", "blank", "duplicate", "truncated", "illegal", best.alias("best")).select("*", "best.cost", "best.audit").drop("best"), "ways")


def edits(ways: DataFrame, placed: DataFrame) -> DataFrame:
    """(conv_id, pos, line, role): what stays or is inserted, in order of ``line``; role is null where the row keeps its own."""
    kept_first = F.length(F.regexp_extract("audit", "^D*", 0))
    starts = ways.select("conv_id", "audit", F.when(F.substring(F.col("audit"), kept_first + 1, F.lit(1)) == "K", kept_first).otherwise(-1).alias("at"))
    system = placed.filter("own = 's'").select(F.col("conv_id").alias("c"), F.col("pos").alias("p"), F.lit(True).alias("system"))
    starts = starts.join(system, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") == F.col("p")), "left")
    kind = typed(ways, "conv_id")
    ship(ways.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, audit, system in zip(batch.column("conv_id"), batch.column("audit").to_pylist(), batch.column("system").to_pylist()):
                pos, line, out = 0, 0, []
                for edit in audit:
                    if edit != "D":
                        turn = line - bool(system)
                        out.append((None if edit == "I" else pos, line, None if edit == "K" else ROLES["ua"[turn % 2]]))
                        line += 1
                    pos += edit != "I"
                    if len(out) == 4096:
                        yield chunk(conv, out)
                        out = []
                if out:
                    yield chunk(conv, out)

    def chunk(conv: pa.Scalar, out: list[tuple]) -> pa.RecordBatch:
        pos, line, role = zip(*out)
        return pa.RecordBatch.from_arrays([pa.repeat(conv, len(out)), pa.array(pos, pa.int64()), pa.array(line, pa.int64()), pa.array(role, pa.string())], names=["conv_id", "pos", "line", "role"])

    return starts.select("conv_id", "audit", "system").mapInArrow(run, f"{kind}, pos long, line long, role string")


def repaired_turns(rows: DataFrame, placed: DataFrame, ways: DataFrame) -> DataFrame:
    """(conv_id, line, role, text): the repaired conversations. A text is kept once at most, so no key of these joins is frequent."""
    kept = edits(ways, placed)
    own = placed.select(F.col("conv_id").alias("c"), F.col("pos").alias("p"), F.col("role").alias("own_role"), "text_digest")
    kept = kept.join(own, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p")), "left").drop("c", "p", "pos")
    stored = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), _tied(F.col("text")).alias("d")).agg(F.any_value("text").alias("text"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("own_role") == F.col("r")) & (F.col("text_digest") == F.col("d"))
    return kept.join(stored, same, "left").select("conv_id", "line", F.coalesce("role", "own_role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): every conversation's lines pass through one hash, a batch in memory at a time."""
    kind = typed(turns, "conv_id")
    ship(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([here], type=ids), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            ids = batch.column("conv_id").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if state is not None and conv == here:
                    state.update(b"\n")
                else:
                    if state is not None:
                        yield done()
                    here, state = conv, hashlib.sha256()
                state.update(f"{role}:{text}".encode())
        if state is not None:
            yield done()

    sorted_turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "line")
    return sorted_turns.mapInArrow(run, f"{kind}, repaired_sha256 string")


def repaired_long(rows: DataFrame) -> DataFrame:
    """``repair`` of conversations of any length."""
    placed = numbered(rows)
    ways = least_ways(placed)
    gaps = placed.groupBy(F.col("conv_id").alias("g")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
    hashed = digests(repaired_turns(rows, placed, ways)).withColumnRenamed("conv_id", "h")
    found = ways.join(gaps, F.col("conv_id").eqNullSafe(F.col("g"))).join(hashed, F.col("conv_id").eqNullSafe(F.col("h")), "left")
    digest = F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", digest)


def damaged(conversations: DataFrame) -> DataFrame:
    """The query's rows: each damaged, or not, by the checksum of its conversation and turn; ``copies`` is 0 for those dropped."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("damage"))
    damage = F.col("damage")
    return rows.select(
        "conv_id",
        "turn",
        F.when(damage == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(damage == 1, "").when(damage == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(damage == 0, 0).when(damage == 3, 2).otherwise(1).alias("copies"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(read(spark, sf_dir, "conversations")), "copies")


#: CRC-32 of an ASCII text as a fold over its bits, modulo 20.
_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
_BITS = f"flatten(list_transform(string_split({_KEY}, ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
_CRC = f"xor(list_reduce({_BITS}, lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), CAST(4294967295 AS BIGINT)), 4294967295) % 20"
#: Row by row: from the least (cost, audit) of each state of the grammar to those behind the next row, up to two insertions
#: before it. More never pay, as two lead back to a state that reads the same initials.
ORACLE = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS x, crc FROM (SELECT *, {crc} AS crc FROM conversations)),
bent AS (
  SELECT conv_id, turn, CASE WHEN crc = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN crc = 1 THEN '' WHEN crc = 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS x, unnest(range(CASE WHEN crc = 3 THEN 2 ELSE 1 END)) AS copy
  FROM raw WHERE crc <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(x), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, x ORDER BY turn NULLS FIRST, copy) AS time FROM bent),
coded AS (
  SELECT *, x NOT SIMILAR TO '[\x20\x09-\x0D]*' AS said, regexp_extract(x, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending, left(role, 1) AS own,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS own_before FROM placed),
r AS (
  SELECT *, NOT said AS blank, said AND time > 1 AS again, said AND time = 1 AND ending NOT IN ('.', '!', '?') AS cut FROM coded),
counts AS (
  SELECT conv_id, count(*) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate,
         count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE own_before IS NOT NULL AND own_before || own NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id),
arcs(a, b, initial) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')),
ins(a, b, cost, audit) AS (
  SELECT g, g, 0, '' FROM (SELECT unnest(range(4)) AS g) UNION ALL SELECT a, b, 5, 'I' FROM arcs WHERE initial <> 's'
  UNION ALL SELECT x.a, y.b, 10, 'II' FROM arcs x JOIN arcs y ON x.b = y.a WHERE x.initial <> 's' AND y.initial <> 's'),
edits AS (
  SELECT conv_id, i, g AS a, g AS b, 2 AS cost, 'D' AS audit FROM r, (SELECT unnest(range(4)) AS g)
  UNION ALL SELECT conv_id, i, a, b, CASE WHEN own = initial THEN 0 ELSE 1 END + CASE WHEN cut THEN 5 ELSE 0 END, CASE WHEN own = initial THEN 'K' ELSE 'R' END
  FROM r, arcs WHERE NOT blank AND NOT again AND (own = initial OR initial <> 's')),
moves AS (SELECT e.conv_id, e.i, s.a, e.b, s.cost + e.cost AS cost, s.audit || e.audit AS audit FROM edits e JOIN ins s ON s.b = e.a),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS g, 0 AS cost, '' AS audit FROM counts
  UNION ALL
  SELECT conv_id, i, g, cost, audit FROM (
    SELECT w.conv_id, m.i, m.b AS g, w.cost + m.cost AS cost, w.audit || m.audit AS audit, row_number() OVER (PARTITION BY w.conv_id, m.b ORDER BY w.cost + m.cost, w.audit || m.audit) AS nth
    FROM walk w JOIN moves m ON m.conv_id = w.conv_id AND m.i = w.i + 1 AND m.a = w.g) WHERE nth = 1),
best AS (
  SELECT conv_id, cost, audit FROM (
    SELECT w.conv_id, w.cost + s.cost AS cost, w.audit || s.audit AS audit, row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + s.cost, w.audit || s.audit) AS nth
    FROM walk w JOIN counts c ON c.conv_id = w.conv_id AND c.n = w.i JOIN ins s ON s.a = w.g WHERE s.b IN (0, 3)) WHERE nth = 1),
done AS (SELECT conv_id, nr, audit[nr] AS edit, nr - len(replace(audit[1:nr], 'I', '')) AS skipped, len(replace(audit[1:nr], 'D', '')) AS line FROM (SELECT *, unnest(range(1, len(audit) + 1)) AS nr FROM best)),
kept AS (
  SELECT d.conv_id, d.edit, d.line, r.role, r.x, max(CASE WHEN d.line = 1 AND d.edit = 'K' AND r.own = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY d.conv_id) AS headed
  FROM done d LEFT JOIN r ON r.conv_id = d.conv_id AND r.i = d.nr - d.skipped AND d.edit <> 'I' WHERE d.edit <> 'D'),
lines AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (line - headed) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE x END, chr(10) ORDER BY line) AS whole
  FROM kept GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN lines USING (conv_id)
""".replace("{crc}", _CRC)
