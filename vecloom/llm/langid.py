"""Language identification as inference of a mixture.

Every language has a model of character trigrams of words. A document's words are draws from a mixture of
languages; expectation-maximisation finds the proportions, and of the nested sets of its largest languages
the one with the best likelihood less a penalty for each language is selected. The largest proportion in that
set is the prediction's score.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import id_crc, map_batches, spread, texts, typed
from vecloom.shipping import ship

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Words whose likelihoods a worker keeps.
CACHE = 1 << 16
#: Trigrams that are drawn from one language together. A run of letters without spaces may be a whole text in many.
PIECE = 40


def marked_grams(marked: str) -> list[str]:
    return [marked[i : i + 3] for i in range(len(marked) - 2)]


def grams(word: str) -> list[str]:
    """Trigrams of a word between marks: one for each letter."""
    return marked_grams(f"^{word}$")


def pieces(word: str) -> list[str]:
    """A word between marks; one of over PIECE letters in pieces that overlap by two, so that each trigram is in one."""
    marked = f"^{word}$"
    return [marked[i : i + PIECE + 2] for i in range(0, len(word), PIECE)]


def words_of(text: str) -> Counter[str]:
    """The runs with a letter, and how often they occur."""
    counted = Counter(LETTERS.findall(text.lower()))
    return Counter({w: n for w, n in counted.items() if w.isalpha() or any(c.isalpha() for c in w)})


def marked_runs(text: str, low: int, high: int) -> list[str]:
    """The runs of letters in a part of a text, between marks; at an edge within a run its next letter stands for the mark."""
    out = [f"^{w}$" for w in LETTERS.findall(text[low:high].lower())]
    within = lambda at: 0 < at < len(text) and LETTERS.fullmatch(text[at - 1].lower()[-1] + text[at].lower()[0])
    if within(low):
        out[0] = text[low - 1].lower()[-1] + out[0][1:]
    if within(high):
        out[-1] = out[-1][:-1] + text[high].lower()[0]
    return out


class Memo:
    """Likelihoods of pieces of words under one model."""

    def __init__(self, owner: Mixture):
        self.owner = owner
        self.words: dict[str, int] = {}
        self.likely = np.empty((CACHE, len(owner.languages)), np.float32)


#: Of the model in use only: a worker meets many models in its life, and one memo is all that it keeps.
_MEMO: Memo | None = None


def memo(owner: Mixture) -> Memo:
    global _MEMO
    if _MEMO is None or _MEMO.owner is not owner:
        _MEMO = Memo(owner)
    return _MEMO


class Mixture:
    """log_p: language by trigram, from counts with additive smoothing ``alpha``."""

    def __init__(self, languages: list[str], counts: dict[str, list[float]], alpha: float = 0.5, rounds: int = 15, penalty: float = 2.0):
        self.languages, self.rounds, self.penalty = languages, rounds, penalty
        table = np.array(list(counts.values()), np.float64).reshape(len(counts), len(languages))
        total = table.sum(axis=0) + alpha * (len(counts) + 1)
        self.row = {g: i for i, g in enumerate(counts)}
        self.n_letters = len({c for g in counts for c in g}) or 1
        self.log_p = np.vstack([np.log((table + alpha) / total), np.log(alpha / total)]).astype(np.float32)

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods of words as ``pieces`` gives them, word by language."""
        kept = memo(self)
        known = kept.words
        new = [w for w in words if w not in known]
        if len(new) + len(known) > CACHE:
            known.clear()
            new = words
        if new:
            get, other = self.row.get, len(self.row)
            parts = [[get(g, other) for g in marked_grams(w)] for w in new]
            start = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
            flat = self.log_p[[i for p in parts for i in p]]
            at = len(known)
            kept.likely[at : at + len(new)] = np.add.reduceat(flat, start, axis=0)
            known.update(zip(new, range(at, at + len(new))))
        return kept.likely[[known[w] for w in words]]

    def proportions(self, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """EM from equal shares: the languages' proportions, and the log-likelihood. p: word by language, n: counts.

        It ends when no share moves by 0.0001, or after ``rounds`` rounds.
        """
        share, total = np.full(p.shape[1], 1.0 / p.shape[1]), n.sum()
        for _ in range(self.rounds if p.shape[1] > 1 else 0):
            mixed = p @ share
            new = share * ((n / mixed) @ p) / total
            if np.abs(new - share).max() < 1e-4:
                share = new
                break
            share = new
        return share, float(n @ np.log(p @ share))

    def infer(self, text: str) -> tuple[str, float, list[tuple[str, float]]]:
        """Language, score and the selected set with proportions; und, 0 and [] if there is no letter.

        Languages equal in proportion stand in the order of their names.
        """
        return self.judge(text)[:3]

    def judge(self, text: str) -> tuple[str, float, list[tuple[str, float]], bool]:
        """``infer``'s, and whether the selected set explains the trigrams better than letters drawn at random do."""
        count: Counter[str] = Counter()
        for w, times in words_of(text).items():
            if len(w) <= PIECE:
                count[f"^{w}$"] += times
            else:
                for piece in pieces(w):
                    count[piece] += times
        if not count or not self.languages:
            return UNKNOWN, 0.0, [], False
        n = np.fromiter(count.values(), np.float64, len(count))
        logs = np.concatenate([self.word_rows(part) for part in _parts(list(count))]).astype(np.float64)
        top = logs.max(axis=1, keepdims=True)
        p = np.maximum(np.exp(logs - top), 1e-12)
        share, likely = self.proportions(p, n)
        order = np.argsort(-share, kind="stable")
        # no shares have a likelihood above this: it is concave, and by Jensen's inequality above any point's by as
        # much as the largest multiplier of a next step tells
        most = likely + n.sum() * np.log(((n / (p @ share)) @ p).max() / n.sum())
        best, chosen, cost = -np.inf, order[:1], self.penalty * np.log(n.sum() + 1)
        for size in range(1, len(order) + 1):
            if most - cost * (size - 1) <= best:  # larger sets can't be better
                break
            part, likely = self.proportions(p[:, order[:size]], n)
            if likely - cost * (size - 1) > best:
                best, chosen, shares = likely - cost * (size - 1), order[:size], part
        ranked = sorted(zip(-shares, chosen))
        at_random = -3 * np.log(self.n_letters) * (n @ (np.fromiter(map(len, count), np.float64, len(count)) - 2))
        return self.languages[ranked[0][1]], float(-ranked[0][0]), [(self.languages[i], float(-s)) for s, i in ranked], bool(best + n @ top[:, 0] > at_random)


def _parts(words: list[str], size: int = CACHE // 2) -> list[list[str]]:
    return [words[i : i + size] for i in range(0, len(words), size)]


def fit(docs: DataFrame, learn: Column, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_each: int = 1500, max_chars: int = 20_000, min_count: int = 2) -> Mixture:
    """The model from a bounded sample of the rows for which ``learn`` holds: about ``docs_each`` of each language.

    What is drawn are parts of ``max_chars`` letters of the texts, so that texts of any length teach in proportion
    to it: by a hash of the id and the part's number against a threshold from the language's number of parts. No
    group of rows is gathered anywhere. Null or empty langs and null texts teach nothing; rows that repeat teach again;
    a null id is drawn like an empty one. Trigrams seen fewer than ``min_count`` times are left out. Without a row that
    teaches the model has no language.
    """
    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("doc_id"))
    known = known.filter(learn & F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("text").isNotNull())
    n_parts = F.greatest(F.lit(1), F.ceil(F.length("text") / max_chars)).cast("int")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.sum(n_parts).alias("n")).collect()}  # one row a language
    if not sizes:
        return Mixture([], {})
    languages = sorted(sizes)
    draw = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    limit = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1 << 30, (docs_each << 30) // sizes[k])))])
    # the first part is drawn by the id alone
    drawn = lambda part: F.pmod(F.when(part == 0, draw).otherwise(F.xxhash64(draw, part)), F.lit(1 << 30)) < limit[F.col("lang")]
    sample = known.select("lang", "text", F.filter(F.sequence(F.lit(0), n_parts - 1), drawn).alias("parts")).filter(F.size("parts") > 0)

    def run(batch: pa.RecordBatch) -> dict:
        found: dict[str, Counter] = {}
        for lang, text, parts in zip(batch.column("lang").to_pylist(), texts(batch, "text"), batch.column("parts").to_pylist()):
            into = found.setdefault(lang, Counter())
            for part in parts:
                for marked, n in Counter(marked_runs(text, part * max_chars, (part + 1) * max_chars)).items():
                    for g in marked_grams(marked):
                        into[g] += n
        flat = [(lang, g, n) for lang, c in found.items() for g, n in c.items()]
        return {"lang": [x[0] for x in flat], "gram": [x[1] for x in flat], "n": [x[2] for x in flat]}

    counted = map_batches(sample, run, "lang string, gram string, n long", 1024).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = {k: i for i, k in enumerate(languages)}
    counts: dict[str, list[float]] = {}
    for row in counted.filter(F.col("n") >= min_count).collect():  # bounded by the sample
        counts.setdefault(row["gram"], [0.0] * len(languages))[place[row["lang"]]] = float(row["n"])
    return Mixture(languages, dict(sorted(counts.items())))


def identify(docs: DataFrame, model: Mixture, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, text and other columns are read by name only: doc_id, lang_pred, score, languages (name, share).

    Null texts and texts without a letter are und with score 0, and so is every text if no language was learned: there is
    none to name. Repeated rows are judged one by one, an
    empty table gives an empty result. Texts are read whole.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        out = [held.value.infer(x) for x in texts(batch, "text")]
        return {
            "doc_id": batch.column("doc_id"),
            "lang_pred": [x[0] for x in out],
            "score": [min(1.0, max(0.0, x[1])) for x in out],
            "languages": [[{"lang": k, "share": s} for k, s in x[2]] for x in out],
        }

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, f"{typed(rows, 'doc_id')}, lang_pred string, score double, languages array<struct<lang string, share double>>")


def held_out(id_col: str = "doc_id") -> Column:
    return id_crc(id_col) % 4 == 2


def documents_in_a_language(docs: DataFrame, model: Mixture, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Documents, columns unchanged, without those that are in no language; ``lang`` is the one that is inferred.

    In no language are null texts, texts without a letter, and texts that letters drawn at random explain better than
    the selected languages do. A model without a language knows only letters: it keeps texts with one and every
    lang. Repeated rows are judged one by one; texts are read whole; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def language(text: str) -> str | None:
        mixture = held.value
        if not mixture.languages:
            return UNKNOWN if words_of(text) else None
        lang, _, _, known = mixture.judge(text)
        return lang if known else None

    # Spark would put the filter before the projection and infer twice, if it took the function for deterministic
    inferred = F.pandas_udf(lambda text: text.map(lambda x: language(x or "")).astype(object), "string").asNondeterministic()
    rows = spread(docs).select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    rows = rows.select("row", inferred(F.col("row")[text_col]).alias("found")).filter("found IS NOT NULL")
    lang = F.col("found") if model.languages else F.col("row")[lang_col]
    return rows.select(*[(lang if c == lang_col else F.col("row")[c]).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, ~held_out())
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")
