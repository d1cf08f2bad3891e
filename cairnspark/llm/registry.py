"""Queries and SQL of the llm operators."""

from __future__ import annotations

from . import byte_bpe, chat, filter_audit, hard_negatives, jaccard, language_id, line_dedup, lm, lsh, packing, suffix, topk, toxicity

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_topk": topk.op2_topk,
    "op3_chat_format": chat.op3_chat_format,
    "op4_suffix_dedup": suffix.op4_suffix_dedup,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_ann": lsh.op6_ann,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_lm_score": lm.op8_lm_score,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_packing": packing.op10_packing,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL = {
    "op2_topk": topk.ORACLE_SQL,
    "op3_chat_format": chat.ORACLE_SQL,
    "op7_jaccard_join": jaccard.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
}
