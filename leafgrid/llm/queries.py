"""Queries of the corpus operators, each over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, jaccard, langid, mixture, quality, secrets, suffixes, tokens, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_url_filter": urls.op2_url_filter,
    "op3_suffix_dedup": suffixes.op3_suffix_dedup,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_ngram_jaccard_join": jaccard.op6_ngram_jaccard_join,
    "op7_source_mixture": mixture.op7_source_mixture,
    "op8_token_counts": tokens.op8_token_counts,
    "op9_nearest_neighbours": ann.op9_nearest_neighbours,
    "op10_language_id": langid.op10_language_id,
}

ORACLE_SQL: dict[str, str] = {"op5_secret_scan": secrets.SQL, "op7_source_mixture": mixture.SQL}
