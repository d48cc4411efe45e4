"""The queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontaminate, exact_dedup, importance, license_scan, lm_score, packing, quality, simhash, spelling, substring_dedup, suffix_dedup, url_filter

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_simhash": simhash.query,
    "op4_quality": quality.query,
    "op5_packing": packing.query,
    "op6_license_scan": license_scan.query,
    "op7_url_filter": url_filter.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_chat_format": chat.query,
    "op10_lm_score": lm_score.query,
    "op11_suffix_dedup": suffix_dedup.query,
    "op12_importance": importance.query,
    "op13_spelling": spelling.query,
}

ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
    "op9_chat_format": chat.ORACLE,
    "op11_suffix_dedup": suffix_dedup.ORACLE,
    "op12_importance": importance.ORACLE,
    "op13_spelling": spelling.ORACLE,
}
