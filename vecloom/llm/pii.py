r"""Personal data: patterns, and terms that reveal a protected entity.

Entities are the values that the patterns find. For each entity c and each term t within ``window`` words of
it, documents are counted: n(c), n(c,t) around the entity and n(t) in the whole corpus. t discloses c to the
degree pmi(c;t)/ic(c) = log(p(c,t)/(p(c)p(t))) / -log p(c), which is 1 if t never occurs without c. Terms of
degree ``generalise`` or more are generalised wherever they occur; those of degree ``remove`` or more are removed.

A degree counts only with evidence that is not chance: the information of m different texts, m/q * KL(q || p(c))
with q = p(c|t), bounds by exp(-information) the probability that a term which has nothing to do with c is seen so
often with it. Over all pairs (c, t) that are looked at, at most ``chance`` such terms are expected. A rare entity
needs few texts for that (two, where all its terms' other uses are few), a common one more.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.durable import broadcast_if_small, materialize
from vecloom.llm.common import map_batches, spread, texts, typed
from vecloom.shipping import ship

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits that fails as a whole fails from every later digit too: matches start where no digit stands before.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
TERM = re.compile(r"[^\W_]+")
#: Disclosing terms go to the workers as one set up to this many; beyond, each document gets its own by joins.
MAX_TERMS = 500_000


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain; each @ is looked at once, so long texts take linear time."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if at >= end:
            low = max(end, text.rfind("@", end, at) + 1)
            before = text[low:at]
            # the run of local characters that ends at the @: found from its end
            gap = NOT_LOCAL.search(before[::-1])
            start = at - (gap.start() if gap else len(before))
            if start < at and (m := DOMAIN.match(text, at + 1)):
                out.append((start, m.end()))
                end = m.end()
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def small(part: str) -> bool:
    return len(part := part.lstrip("0")) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the patterns' matches, sorted; failing matches are dropped without another try."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(map(small, m.group().split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(text: str, span: tuple[int, int, int]) -> str:
    """An entity's name: kind and value, letters in lower case, other kinds by their digits and dots."""
    value = text[span[0] : span[2]].lower()
    return f"{KINDS[span[1]]}:{value if span[1] < 2 else re.sub('[^0-9]', '', value)}"


def _free_terms(text: str, spans: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """The terms that touch none of the sorted spans: one walk over both."""
    i, reach = 0, 0
    for m in TERM.finditer(text):
        while i < len(spans) and spans[i][0] < m.end():
            reach, i = max(reach, spans[i][2]), i + 1
        if m.start() >= reach:
            yield m


def contexts(text: str, spans: list[tuple[int, int, int]], window: int) -> set[tuple[str, str]]:
    """(entity, term) for the ``window`` terms on either side of each span; spans themselves hold no terms."""
    out = set()
    starts, ends = array("q"), array("q")
    for m in _free_terms(text, spans):
        starts.append(m.start())
        ends.append(m.end())
    for span in spans:
        left, right = bisect_right(ends, span[0]), bisect_left(starts, span[2])
        near = [*range(max(0, left - window), left), *range(right, min(right + window, len(starts)))]
        name = entity(text, span)
        out.update((name, text[starts[i] : ends[i]].lower()) for i in near)
    return out


def terms_of(text: str) -> set[str]:
    """A text's different terms, cut first and then each in lower case."""
    return set(map(str.lower, TERM.findall(text)))


def _terms(text: Column) -> Column:
    """The same in the JVM, to count them; where its letters and case are not Python's, contexts give the least count."""
    return F.array_distinct(F.transform(F.split(text, r"[^\p{L}\p{N}]+"), F.lower))


def disclosing_terms(docs: DataFrame, *, window: int = 8, generalise: float = 0.9, chance: float = 0.01, text_col: str = "text") -> DataFrame:
    """term, degree (the largest over entities) of terms that disclose an entity; counted over all documents.

    Copies of one text are evidence once, though each counts as a document. Null texts are empty; no documents, no
    entities or no evidence give an empty table; columns besides the text are not looked at.
    """
    spark = docs.sparkSession

    def run(batch: pa.RecordBatch) -> dict | None:
        names, terms, digests = [], [], []
        for text in texts(batch, "text"):
            if spans := base_spans(text):
                digest = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=7).digest())
                for name, term in contexts(text, spans, window) | {(entity(text, s), "") for s in spans}:
                    names.append(name)
                    terms.append(term)
                    digests.append(digest)
        return {"entity": names, "term": terms, "text_key": digests} if names else None

    rows = docs.select(F.col(text_col).alias("text"))
    pairs = map_batches(rows, run, "entity string, term string, text_key long")
    by_text = materialize(pairs.groupBy("entity", "term", "text_key").agg(F.count(F.lit(1)).alias("n")), "pii-contexts")
    counted = by_text.groupBy("entity", "term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_texts"))
    counted = materialize(counted, "pii-pairs")
    total, looked_at = float(max(docs.count(), 2)), counted.filter("term <> ''").count()
    if not looked_at:
        return spark.createDataFrame([], "term string, degree double")
    needed = math.log(looked_at / chance)
    entities = counted.filter("term = ''").select("entity", F.col("n").alias("n_entity"))

    def discloses(n_term: str) -> tuple[Column, Column]:
        """The degree, and whether the term passes, if it is in so many documents."""
        p_c = F.col("n_entity") / F.lit(total)
        given = F.least(F.lit(1.0), F.col("n") / F.col(n_term))
        degree = F.when(p_c < 1, F.log(given / p_c) / -F.log(p_c)).otherwise(F.lit(0.0))
        other = F.when(given < 1, (1 - given) * F.log((1 - given) / (1 - p_c))).otherwise(F.lit(0.0))
        information = F.col("n_texts") / given * (given * F.log(given / p_c) + other)
        return degree, (p_c < 1) & (degree >= generalise) & (given > p_c) & (information >= needed)

    # no term has more information than -log p(c) a text; and one is in as many texts as contexts show at least:
    # what fails by these bounds fails by the count as well
    likely = counted.filter((F.col("term") != "") & (F.col("n_texts") * math.log(total) >= needed))
    shown = by_text.filter("term <> ''").select("term", "text_key").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_shown"))
    together = likely.join(shown, "term").join(entities, "entity").filter(discloses("n_shown")[1])
    together = materialize(together.select("entity", "term", "n", "n_texts", "n_entity", "n_shown"), "pii-together")
    candidates = materialize(together.select("term").distinct(), "pii-candidates")
    if candidates.isEmpty():
        return spark.createDataFrame([], "term string, degree double")
    # n(t): the number of documents with the term, over the whole corpus
    found = rows.select(F.explode(_terms(F.col("text"))).alias("term"))
    found = found.join(broadcast_if_small(candidates, MAX_TERMS), "term", "left_semi")
    frequency = found.groupBy("term").agg(F.count(F.lit(1)).alias("n_found"))
    known = together.join(frequency, "term", "left").withColumn("n_term", F.greatest("n_shown", F.coalesce("n_found", F.lit(0))))
    degree, passes = discloses("n_term")
    return materialize(known.filter(passes).select("term", degree.alias("degree")).groupBy("term").agg(F.max("degree").alias("degree")), "pii-terms")


def all_spans(text: str, terms) -> list[tuple[int, int, int, str]]:
    """(start, kind's place, end, kind): base spans, and the terms outside them."""
    base = base_spans(text)
    out = [(s, k, e, KINDS[k]) for s, k, e in base]
    if terms:
        # each term in lower case by itself: a text's own lower case may be longer and cut terms in two
        if not terms.isdisjoint(terms_of(text)):
            out += [(m.start(), len(KINDS), m.end(), "term") for m in _free_terms(text, base) if m.group().lower() in terms]
    return sorted(out)


def listed(spans) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)


def sanitised(text: str, spans, degree: dict[str, float], remove: float) -> str:
    """The text with spans replaced: base kinds by their names, terms by what kind of word they are or by nothing."""
    out, at = [], 0
    for s, _, e, kind in spans:
        if s < at:  # kinds may overlap: the first one stands for both
            at = max(at, e)
            continue
        word = text[s:e]
        if kind != "term":
            shown = f"<{kind}>"
        elif degree.get(word.lower(), 0.0) >= remove:
            shown = ""
        else:
            shown = "<number>" if word.isdigit() else "<name>" if word[:1].isupper() else "<word>"
        out += [text[at:s], shown]
        at = e
    return "".join(out) + text[at:]


def _held(docs: DataFrame, terms: DataFrame):
    """The terms and their degrees for every worker, or None if they are too many."""
    ship(docs.sparkSession)
    few = terms.count() <= MAX_TERMS
    return docs.sparkSession.sparkContext.broadcast({r["term"]: r["degree"] for r in terms.collect()} if few else None)


def _own_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, text_key, terms (term, degree): each text's own disclosing terms, where all are too many for the workers."""

    def run(batch: pa.RecordBatch) -> dict:
        found = [terms_of(x) for x in texts(batch, "text")]
        return {"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "term": [list(x) for x in found]}

    keyed = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    words = map_batches(keyed, run, f"{typed(keyed, 'doc_id')}, text_key long, term array<string>")
    found = words.select("doc_id", "text_key", F.explode("term").alias("term")).distinct().join(terms, "term")
    return found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("term", "degree")).alias("terms"))


def _same_text(rows: str, own: str, id_col: str, text_col: str) -> Column:
    return F.col(f"{rows}.{id_col}").eqNullSafe(F.col(f"{own}.doc_id")) & (F.xxhash64(F.col(f"{rows}.{text_col}")) == F.col(f"{own}.text_key"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", remove: float = 0.999, **options) -> DataFrame:
    """doc_id, counts n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans, sanitised (the text without them).

    Offsets are code points. Null texts are empty and have no spans. Repeated rows are scanned one by one;
    an empty table gives an empty result; other columns are dropped.
    """
    terms = disclosing_terms(docs, text_col=text_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = typed(rows, "doc_id")
    held = _held(docs, terms)
    if held.value is None:
        rows = rows.alias("r").join(_own_terms(rows, terms).alias("o"), _same_text("r", "o", "doc_id", "text"), "left").select("r.doc_id", "r.text", "o.terms")

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        own = [_degrees(x) for x in batch.column("terms").to_pylist()] if held.value is None else [held.value] * batch.num_rows
        for text, degree in zip(texts(batch, "text"), own):
            spans = all_spans(text, degree.keys())
            base = [x for x in spans if x[1] < len(KINDS)]
            n = [sum(x[1] == k for x in spans) for k in range(len(KINDS) + 1)]
            out.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), sanitised(text, spans, degree, remove)))
        names = ("n_email", "n_ip", "n_card", "n_phone", "n_term", "base_sha256", "spans", "sanitised")
        return {"doc_id": batch.column("doc_id")} | {k: list(v) for k, v in zip(names, zip(*out))}

    schema = f"{kind}, n_email long, n_ip long, n_card long, n_phone long, n_term long, base_sha256 string, spans string, sanitised string"
    return map_batches(rows, run, schema)


def _degrees(own: list[dict] | None) -> dict[str, float]:
    return {} if own is None else {x["term"]: x["degree"] for x in own}


def sanitised_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", remove: float = 0.999, **options) -> DataFrame:
    """Documents, columns unchanged, with sanitised texts and their sizes (``size_col``, if there is such a column).

    A null text stays null. Every row is sanitised by itself, repeated ones too; texts are read whole; an empty table
    gives an empty one; other columns are handed on whatever their names.
    """
    terms = disclosing_terms(docs, text_col=text_col, **options)
    held = _held(docs, terms)

    def cleaned(text: str | None, degree: dict[str, float]) -> str | None:
        return None if text is None else sanitised(text, all_spans(text, degree.keys()), degree, remove)

    rows = spread(docs).select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    if held.value is not None:
        by_all = F.pandas_udf(lambda text: text.map(lambda x: cleaned(x, held.value), na_action="ignore"), "string")
        rows = rows.select("row", by_all(F.col("row")[text_col]).alias("clean"))
    else:
        own = _own_terms(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), terms)
        slim = rows.select("row", F.col("row")[id_col].alias("doc_id"), F.col("row")[text_col].alias("text"))
        joined = slim.alias("r").join(own.alias("o"), _same_text("r", "o", "doc_id", "text"), "left")
        term_names = F.transform("o.terms", lambda x: x["term"]), F.transform("o.terms", lambda x: x["degree"])
        by_own = F.pandas_udf(lambda text, names, degrees: pd.Series([cleaned(t, {} if n is None else dict(zip(n, d))) for t, n, d in zip(text, names, degrees)]), "string")
        rows = joined.select("r.row", by_own("r.text", *term_names).alias("clean"))
    replaced: dict[str, Column] = {text_col: F.col("clean"), size_col: F.length("clean").cast("long")}
    return rows.select(*[replaced.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("sanitised")
