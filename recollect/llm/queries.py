"""Queries of the text operators and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from . import conversations, decontaminate, embedding_dedup, exact_dedup, fill_middle, html_text, jaccard, quality, secret_scan, substring_dedup, tokens, toxicity

QUERIES = {
    "op1_jaccard_join": jaccard.op1_jaccard_join,
    "op2_token_output": tokens.op2_token_output,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_html_text": html_text.op5_html_text,
    "op6_quality": quality.op6_quality,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_packing": tokens.op8_packing,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_embedding_near_dedup": embedding_dedup.op11_embedding_near_dedup,
    "op12_fill_in_middle": fill_middle.op12_fill_in_middle,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}
SQL = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op4_decontaminate": decontaminate.SQL,
    "op10_substring_dedup": substring_dedup.SQL,
    "op12_fill_in_middle": fill_middle.SQL,
}
