"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import ann, byte_bpe, jaccard_join, language_id, mixing, quality_rules, suffix_dedup, token_counts, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.query,
    "op2_quality_rules": quality_rules.query,
    "op3_language_id": language_id.query,
    "op4_mixing": mixing.query,
    "op5_ann": ann.query,
    "op6_url_filter": url_filter.query,
    "op7_suffix_dedup": suffix_dedup.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_warc": warc.query,
    "op10_byte_bpe": byte_bpe.query,
}

ORACLE_SQL: dict[str, str] = {
    "op4_mixing": mixing.SQL,
    "op6_url_filter": url_filter.SQL,
    "op9_warc": warc.SQL,
}
