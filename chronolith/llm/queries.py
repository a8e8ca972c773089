"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import exact_dedup, html_extract, jaccard_join, language_id, language_model, packing, pii, quality, sentencepiece_codec, url_filter

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.query,
    "op2_url_filter": url_filter.query,
    "op3_jaccard_join": jaccard_join.query,
    "op4_html_extract": html_extract.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_quality_rules": quality.query,
    "op7_pii": pii.query,
    "op8_language_id": language_id.query,
    "op9_language_model": language_model.query,
    "op10_best_fit_packing": packing.query,
}

ORACLES = {
    "op2_url_filter": url_filter.ORACLE,
    "op3_jaccard_join": jaccard_join.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_quality_rules": quality.ORACLE,
}
