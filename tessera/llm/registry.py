"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tessera.llm import conversations, decontamination, fingerprints, line_dedup, quality, sentence_pieces, simhash, spelling, substring_dedup, suffix_dedup, token_counts, toxicity, url_filters

QUERIES = {
    "op1_url_filters": url_filters.op1,
    "op2_simhash_near_dedup": simhash.op2,
    "op3_token_counts": token_counts.op3,
    "op4_line_dedup": line_dedup.op4,
    "op5_substring_dedup": substring_dedup.op5,
    "op6_toxicity": toxicity.op6,
    "op7_suffix_array_dedup": suffix_dedup.op7,
    "op8_benchmark_decontamination": decontamination.op8,
    "op9_sentence_pieces": sentence_pieces.op9,
    "op10_quality_rules": quality.op10,
    "op11_conversation_repair": conversations.op11,
    "op12_document_fingerprints": fingerprints.op12,
    "op13_spelling_variants": spelling.op13,
}
SQL = {"op7_suffix_array_dedup": suffix_dedup.OP7_SQL, "op5_substring_dedup": substring_dedup.OP5_SQL, "op4_line_dedup": line_dedup.OP4_SQL, "op8_benchmark_decontamination": decontamination.OP8_SQL}
