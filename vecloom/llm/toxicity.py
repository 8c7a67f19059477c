"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its different words and their beginnings;
a document's is the noisy-or of its sentences', 1 - prod(1 - p). Only documents have labels: the weights are
fitted to the documents' likelihood, and the sentences' scores then tell where the offence is.

A long text has many sentences, and small scores add up. Labels are of short texts, so the sentences' scores are made
steeper, all by one factor, until as many clean documents as ``long_bag`` joined to one text are clean: the factor is learned on
these long bags after the weights.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.durable import broadcast_if_small, materialize
from vecloom.llm.common import id_crc, map_batches, texts, typed

WORDS = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+")
STEMS = (4, 5, 6)
OFFENDING = 0.5
#: The exponent that a long bag of clean documents is to have: a score of 0.1.
CLEAN = 0.1
#: Tables of an id and a label are broadcast up to this many rows (some MB), else joined by shuffle.
MAX_BROADCAST_ROWS = 100_000
#: Words whose weights a worker keeps.
CACHE = 1 << 18


def features(word: str) -> list[str]:
    """A lower-case word and its beginnings."""
    return [word, *(f"{word[:n]}~" for n in STEMS if len(word) >= n)]


#: Weights of words under the model in use; a worker meets many models in its life and keeps one memo.
_MEMO: tuple[NoisyOr | None, dict[str, float]] = (None, {})


class NoisyOr:
    """weights: by feature; bias: a sentence's score without any."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def weight(self, word: str) -> float:
        global _MEMO
        if _MEMO[0] is not self:
            _MEMO = (self, {})
        cache = _MEMO[1]
        found = cache.get(word)
        if found is None:
            if len(cache) >= CACHE:
                cache.clear()
            found = cache[word] = float(sum(self.weights.get(f, 0.0) for f in features(word)))
        return found

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """start, end (code points) and score of every sentence."""
        out = []
        for m in SENTENCE.finditer(text):
            z = self.bias + sum(map(self.weight, sorted(set(WORDS.findall(m.group().lower())))))
            out.append((m.start(), m.end(), 1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return out

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """A document's score, the noisy-or of all its sentences (none: 0), and where it offends.

        That is in the sentences of 0.5 or more; if there are none but the score is, in the one of the largest.
        """
        found = self.sentences(text)
        if not found:
            return 0.0, []
        score = float(1 - np.exp(np.log1p(-np.minimum([s for _, _, s in found], 1 - 1e-12)).sum()))
        offending = [x for x in found if x[2] >= OFFENDING]
        if not offending and score >= OFFENDING:
            offending = [max(found, key=lambda x: x[2])]
        return score, offending


def train(
    bags: list[str], labels: list[int], rounds: int = 300, rate: float = 0.1, decay: float = 0.05, spread: float = 50.0, min_docs: int = 3, min_z: float = 3.0, long_bag: int = 1000
) -> NoisyOr:
    """Full-batch Adam on the noisy-or likelihood, then one factor for all weights and the bias from long bags.

    Features are screened first: those in at least ``min_docs`` documents whose share among toxic documents
    differs from that among others by ``min_z`` standard errors.
    """
    y = np.array(labels, float)
    if not y.any() or y.all():
        return NoisyOr({}, -30.0 if not y.any() else 30.0)
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in zip(bags, labels):
        seen[label].update({f for w in set(WORDS.findall(text.lower())) for f in features(w)})
    n1, n0 = y.sum(), (1 - y).sum()
    chosen = []
    for f in seen[0].keys() | seen[1].keys():
        a, b = seen[1][f], seen[0][f]
        p = (a + b) / (n1 + n0)
        error = np.sqrt(max(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
        if a + b >= min_docs and abs(a / n1 - b / n0) >= min_z * error:
            chosen.append(f)
    place = {f: i for i, f in enumerate(sorted(chosen))}
    rows, cols, owner = [], [], []
    for doc, text in enumerate(bags):
        for sentence in SENTENCE.findall(text.lower()):
            at = len(owner)
            for w in sorted(set(WORDS.findall(sentence))):
                for f in features(w):
                    if f in place:
                        rows.append(at)
                        cols.append(place[f])
            owner.append(doc)
    rows, cols, owner = np.array(rows, np.int64), np.array(cols, np.int64), np.array(owner, np.int64)
    balance = np.where(y == 1, (n1 + n0) / (2 * n1), (n1 + n0) / (2 * n0))
    # rare offences in many sentences: start from a low bias and from the features' log ratios, positive ones
    w = np.array([max(0.0, np.log((seen[1][f] + 0.5) / n1) - np.log((seen[0][f] + 0.5) / n0)) for f in place])
    params = np.concatenate([w * 0.5, [-6.0]])
    # a weight is the dearer the fewer documents have the feature: what many words begin with is preferred to the words
    shown = np.array([seen[0][f] + seen[1][f] for f in place], float)
    cost = decay / len(y) * (1 + spread / np.maximum(shown, 1))
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        z = np.bincount(rows, params[cols], minlength=len(owner)) + params[-1]
        z = np.clip(z, -30, 30)
        s = np.bincount(owner, np.logaddexp(0, z), minlength=len(y))
        s = np.maximum(s, 1e-12)
        ds = np.where(y == 1, -1 / np.expm1(np.minimum(s, 50)), 1.0) * balance / len(y)
        dz = ds[owner] / (1 + np.exp(-z))
        grad = np.concatenate([np.bincount(cols, dz[rows], minlength=len(place)), [dz.sum()]])
        grad[:-1] += cost * params[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    z = np.bincount(rows, params[cols], minlength=len(owner)) + params[-1]
    exponents = np.bincount(owner, np.logaddexp(0, z), minlength=len(y))
    clean = (y == 0) & (exponents < np.log(2))
    factor = steepness(z[clean[owner]], int(clean.sum()), long_bag)
    return NoisyOr({f: float(params[i]) * factor for f, i in place.items() if abs(params[i]) > 1e-3}, float(params[-1]) * factor)


def steepness(z: np.ndarray, docs: int, long_bag: int) -> float:
    """The least factor, 1 to 64, with which ``long_bag`` documents like these have an exponent of CLEAN together; z: of all their sentences."""
    exponent = lambda a: np.logaddexp(0, a * z).sum() * long_bag / max(docs, 1)
    low, high = 1.0, 64.0
    if exponent(low) <= CLEAN:
        return low
    for _ in range(30):
        middle = (low + high) / 2
        low, high = (middle, high) if exponent(middle) > CLEAN else (low, middle)
    return high


def held_out(id_col: str = "doc_id") -> Column:
    return id_crc(id_col) % 5 == 0


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, *, docs_each: int = 3000, chars_each: int = 30_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> NoisyOr:
    """The model from a bounded sample of labelled rows for which ``learn`` holds: toxic ones and as many others.

    Of each class about ``docs_each`` rows are drawn, or fewer, so that their texts have about ``chars_each`` characters:
    by a hash of the id against a threshold from the class's rows and characters. A text of any length may be
    drawn, and texts are read whole. A document with several labels counts as toxic if one of them says so; null
    labels, null texts and labels without a document teach nothing; rows of equal id and text teach once.
    """
    marked = labels.filter(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    marked = materialize(marked.groupBy(F.col(id_col).alias("doc_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic")), "marked")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    known = rows.select("doc_id", F.length("text").alias("n")).join(broadcast_if_small(marked, MAX_BROADCAST_ROWS), "doc_id")
    sizes = {r["toxic"]: r for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("chars")).collect()}  # two rows
    share = {k: min(1.0, docs_each / r["rows"], chars_each / max(1, r["chars"])) for k, r in sizes.items()}
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    limit = F.when(F.col("toxic") == 1, F.lit(int(share.get(1, 0) * (1 << 30)))).otherwise(F.lit(int(share.get(0, 0) * (1 << 30))))
    drawn = materialize(marked.filter(draw < limit), "drawn")
    sample = rows.join(broadcast_if_small(drawn, MAX_BROADCAST_ROWS), "doc_id").dropDuplicates(["doc_id", "text"])
    held = sorted(sample.collect(), key=lambda r: (r["doc_id"], r["text"]))  # bounded by the sample
    return train([r["text"] for r in held], [r["toxic"] for r in held])


def score(docs: DataFrame, model: NoisyOr, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted, offending (start, end, score of the sentences to blame, see ``NoisyOr.score``; code points).

    Only texts are looked at, whole. Null and empty texts have no sentence: score 0. Repeated rows are scored
    one by one; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        out = [held.value.score(x) for x in texts(batch, "text")]
        return {
            "doc_id": batch.column("doc_id"),
            "score": [s for s, _ in out],
            "predicted": [int(s >= threshold) for s, _ in out],
            "offending": [[{"start": a, "end": b, "score": float(p)} for a, b, p in found] for _, found in out],
        }

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, f"{typed(rows, 'doc_id')}, score double, predicted int, offending array<struct<start int, end int, score double>>")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "offending")
