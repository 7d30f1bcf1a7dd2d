"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, exact_dedup, fingerprint, html_extract, mixing, near_dedup, packing, quality, toxicity, url_filter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_fingerprint": fingerprint.op2_fingerprint,
    "op3_chat_rotation": chat.op3_chat_rotation,
    "op4_mixing": mixing.op4_mixing,
    "op5_packing": packing.op5_packing,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_url_filter": url_filter.op10_url_filter,
}
ORACLES = {"op3_chat_rotation": chat.ORACLE, "op4_mixing": mixing.ORACLE, "op6_exact_dedup": exact_dedup.ORACLE, "op10_url_filter": url_filter.ORACLE}
