"""Queries of this package for the general test tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from phasewise.llm import (
    op1_sentencepiece,
    op2_url_filter,
    op3_nearest,
    op4_suffix_dedup,
    op5_html_text,
    op6_packing,
    op7_cover_tree,
    op8_minhash,
    op9_toxicity,
    op10_license_scan,
    op11_substring_dedup,
    op12_importance,
    op13_centroids,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece.query,
        "op2_url_filter": op2_url_filter.query,
        "op3_nearest": op3_nearest.query,
        "op4_suffix_dedup": op4_suffix_dedup.query,
        "op5_html_text": op5_html_text.query,
        "op6_packing": op6_packing.query,
        "op7_cover_tree": op7_cover_tree.query,
        "op8_minhash": op8_minhash.query,
        "op9_toxicity": op9_toxicity.query,
        "op10_license_scan": op10_license_scan.query,
        "op11_substring_dedup": op11_substring_dedup.query,
        "op12_importance": op12_importance.query,
        "op13_centroids": op13_centroids.query,
        "pipeline": corpus_pipeline.run,
    }


def statements() -> dict[str, str]:
    return {
        "op2_url_filter": op2_url_filter.SQL,
        "op11_substring_dedup": op11_substring_dedup.SQL,
        "op12_importance": op12_importance.SQL,
        "op13_centroids": op13_centroids.SQL,
    }
