"""Queries of the training-data operators and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from . import conversations, decontaminate, exact_dedup, html_text, licenses, lm_score, mixing, ngram_join, substring_dedup, suffix_dedup, token_counts, toxicity, whitening

QUERIES: dict[str, Callable] = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_html_text": html_text.op7_html_text,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_whitening": whitening.op11_whitening,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_lm_score": lm_score.op13_lm_score,
}

SQL: dict[str, str] = {**suffix_dedup.SQL, **substring_dedup.SQL, **ngram_join.SQL, **exact_dedup.SQL}
