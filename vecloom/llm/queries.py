"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vecloom.llm import conversations, extraction, filter_audit, langid, mixing, pieces, pii, quality, simhash, toxicity, urlfilter, warc, weighted_sampling


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": mixing.query,
        "op2_sentencepiece": pieces.query,
        "op3_url_filters": urlfilter.query,
        "op4_personal_data": pii.query,
        "op5_warc_archive": warc.query,
        "op6_weighted_fingerprints": weighted_sampling.query,
        "op7_simhash_groups": simhash.query,
        "op8_toxicity": toxicity.query,
        "op9_quality_rules": quality.query,
        "op10_language_id": langid.query,
        "op11_html_extraction": extraction.query,
        "op12_filter_audit": filter_audit.query,
        "op13_conversation_repair": conversations.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": mixing.ORACLE,
        "op3_url_filters": urlfilter.ORACLE,
        "op5_warc_archive": warc.ORACLE,
        "op9_quality_rules": quality.ORACLE,
        "op11_html_extraction": extraction.ORACLE,
        "op12_filter_audit": filter_audit.ORACLE,
        "op13_conversation_repair": conversations.ORACLE,
    }
