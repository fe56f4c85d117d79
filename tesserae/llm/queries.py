"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import ann, bpe, jaccard, lines, lm, oracles, packing, quality, substring, suffix, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_fourier_ridge": quality.query,
    "op2_topk_dual_cover_tree": topk.query,
    "op3_jaccard_adaptive_prefixes": jaccard.query,
    "op4_lm_cross_entropy_difference": lm.query,
    "op5_bpe_speculate_verify": bpe.query,
    "op6_ann_ivf_pq": ann.query,
    "op7_lines_deletion_neighbourhood": lines.query,
    "op8_substring_suffix_trees": substring.query,
    "op9_suffix_array_lpf": suffix.query,
    "op10_packing_concatenate_cut": packing.query,
}
#: The others are tested against brute force, the public tokenizer, round trips and held-out labels in tests/llm.
ORACLES: dict[str, str] = {
    "op2_topk_dual_cover_tree": oracles.TOP_K,
    "op3_jaccard_adaptive_prefixes": oracles.JACCARD,
    "op8_substring_suffix_trees": oracles.SUBSTRING,
    "op9_suffix_array_lpf": oracles.BYTES,
}
