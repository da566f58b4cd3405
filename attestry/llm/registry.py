"""The operators' queries, and SQL with the same rows where SQL can express them."""

from __future__ import annotations

from . import bpe, exact_dedup, html_text, near_dedup, neighbours, packing, secrets, substrings, toxicity, urls

QUERIES = {
    "op8_bpe": bpe.op8,
    "op9_packing": packing.op9,
    "op10_exact_dedup": exact_dedup.op10,
    "op1_toxicity": toxicity.op1,
    "op2_url_filter": urls.op2,
    "op3_html_text": html_text.op3,
    "op4_secrets": secrets.op4,
    "op5_neighbours": neighbours.op5,
    "op6_substrings": substrings.op6,
    "op7_near_dedup": near_dedup.op7,
    # parts of operators that SQL can express
    "urls_ruled": urls.ruled_pages,
    "secrets_counted": secrets.counted,
}

ORACLES: dict[str, str] = {
    "op10_exact_dedup": exact_dedup.SQL,
    "op5_neighbours": neighbours.SQL,
    "op6_substrings": substrings.SQL,
    "op7_near_dedup": near_dedup.SQL,
    "op2_url_filter": urls.SQL,
    "urls_ruled": urls.RULES_SQL,
    "secrets_counted": secrets.COUNTS_SQL,
}
