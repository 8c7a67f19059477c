"""Documents to tokens: language, near-duplicates, personal data, mixture, pieces.

Each stage gets the documents that the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vecloom.durable import materialize, release
from vecloom.llm import langid, mixing, pieces, pii, simhash, similar


# All stages: columns besides those named are handed on as they are, whatever their names; an empty table gives an empty one.


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are in a language and says in which (lang); the model learns from the documents' own langs.

    Null texts and texts without a letter go, as do texts that no learned language explains better than random
    letters. Repeated rows, ties of languages and long texts: see ``langid``.
    """
    return langid.documents_in_a_language(docs, langid.fit(docs, ~langid.held_out()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarities of 0.8 or more over five-word shingles join: that with the smallest id.

    Null and empty texts are one group; of rows that repeat the document that stays one is left; a null id stays
    only if its group has no other.
    """
    return simhash.deduplicated(docs, similar.similar_groups(docs))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts (and n_chars) without personal data and the terms that disclose it. Null texts stay null, repeated rows are rows."""
    return pii.sanitised_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; columns as before.

    A null source is a source; texts without words stay as often as their source has epochs; rows equal in id,
    source and size share their copies.
    """
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids, decoded text and spans, and the ids themselves, a row for every row. Null texts are empty."""
    return pieces.round_trip(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("personal_data", remove_personal_data),
    ("mix_sources", mix_sources),
    ("sentencepiece", tokenize),
]

#: The stages learn, group and tokenize: none of it is SQL. The tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), name)
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
