"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from rankloom.llm import decontaminate, language, mixing, near_dup, pagetext, pii, quality, secretscan, subwords, topk, toxicity, turns, variants

QUERIES = {
    "op1_url_page_differencing": pagetext.query,
    "op2_prefix_decontamination": decontaminate.query,
    "op3_odd_sketch_near_dup": near_dup.query,
    "op4_histogram_top_k": topk.query,
    "op5_word_first_language": language.query,
    "op6_context_mixing": mixing.query,
    "op7_n_best_pieces": subwords.query,
    "op8_deobfuscated_pii": pii.query,
    "op9_nearest_toxic": toxicity.query,
    "op10_pairwise_quality": quality.query,
    "op11_token_efficiency_secrets": secretscan.query,
    "op12_q_chunk_variants": variants.query,
    "op13_branch_bound_repair": turns.query,
}

ORACLE_SQL = {
    "op2_prefix_decontamination": decontaminate.SQL,
    "op3_odd_sketch_near_dup": near_dup.SQL,
    "op4_histogram_top_k": topk.SQL,
    "op12_q_chunk_variants": variants.SQL,
    "op13_branch_bound_repair": turns.SQL,
}
