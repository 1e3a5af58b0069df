"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, html_extract, line_dedup, near_dup, packing, quality_rules, sharding, token_counts, toxicity

QUERIES = {
    "op1_decontamination": decontaminate.query,
    "op2_toxicity": toxicity.query,
    "op3_sharding": sharding.query,
    "op4_token_counts": token_counts.query,
    "op5_chat_format": chat_format.query,
    "op6_near_dup": near_dup.query,
    "op7_html_extraction": html_extract.query,
    "op8_quality_rules": quality_rules.query,
    "op9_packing": packing.query,
    "op10_line_dedup": line_dedup.query,
}
SQL = {
    "op5_chat_format": chat_format.SQL,
    "op8_quality_rules": quality_rules.SQL,
}
