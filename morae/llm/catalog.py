"""The queries of this subpackage, and their SQL where SQL can express them.

Every query takes (spark, sf_dir) and applies its operator, with production parameters, to its whole table. Each
operator's module is imported when its query is called.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .common import table


def _query(module: str, function: str, *sources: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(import_module(f"{__package__}.{module}"), function)(*(table(spark, sf_dir, x) for x in sources or ("documents",)))

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scans": _query("licenses", "query"),
        "op2_quality_rules": _query("quality", "query"),
        "op3_lm_scoring": _query("mixing_lm", "query"),
        "op4_line_dedup": _query("line_dedup", "every_line"),
        "op5_media_columns": _query("jpeg", "query"),
        "op6_sentencepiece": _query("sentencepiece_codec", "digests"),
        "op7_best_fit_packing": _query("packing", "query"),
        "op8_html_extraction": _query("html_crf", "query", "pages"),
        "op9_substring_dedup": _query("substrings", "query"),
        "op10_ngram_jaccard": _query("jaccard", "query"),
        "op11_quality_classifier": _query("quality_net", "query", "documents", "labels"),
        "op12_spelling_variants": _query("spelling", "query"),
        "op13_centroid_clustering": _query("centroids", "query", "embeddings"),
        "pipeline": _pipeline,
    }


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module("corpus_pipeline").run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    from . import oracle

    return oracle.SQL
