"""Registry of the training-data queries."""

from __future__ import annotations

from tessera.llm import bpe, chat, exact_dedup, language_id, lm_scoring, media_tiff, mixing, ngram_join, periodic_runs, quality, source_divergence, substring_dedup, toxicity

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_language_id": language_id.op2_language_id,
    "op3_chat_format": chat.op3_chat_format,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_ngram_jaccard_join": ngram_join.op5_ngram_jaccard_join,
    "op6_media_tiff": media_tiff.op6_media_tiff,
    "op7_lm_scoring": lm_scoring.op7_lm_scoring,
    "op8_bpe": bpe.op8_bpe,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_source_divergence": source_divergence.op13_source_divergence,
}

ORACLES = {
    "op3_chat_format": chat.ORACLE,
    "op5_ngram_jaccard_join": ngram_join.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op10_substring_dedup": substring_dedup.ORACLE,
    "op11_periodic_runs": periodic_runs.ORACLE,
    "op13_source_divergence": source_divergence.ORACLE,
}
