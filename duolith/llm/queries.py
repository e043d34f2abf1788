"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, ngram_join, pii, quality_rules, rule_ensemble, secret_scan, source_mix, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": url_filter.query,
        "op2_quality_rules": quality_rules.query,
        "op3_secret_scan": secret_scan.query,
        "op4_exact_dedup": exact_dedup.query,
        "op5_source_mix": source_mix.query,
        "op6_rule_ensemble": rule_ensemble.query,
        "op7_bpe": bpe.query,
        "op8_warc": warc.query,
        "op9_ngram_join": ngram_join.query,
        "op10_pii": pii.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.SQL,
        "op2_quality_rules": quality_rules.SQL,
        "op4_exact_dedup": exact_dedup.SQL,
        "op5_source_mix": source_mix.SQL,
        "op8_warc": warc.SQL,
        "op9_ngram_join": ngram_join.SQL,
    }
