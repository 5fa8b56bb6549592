"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from citelink.llm import embed_dup, fingerprint, html_text, lang_id, line_dedup, merkle, mixing, near_dup, ngram_lm, pieces, pii, runs, suffix_dedup

QUERIES = {
    "op1_html_text": html_text.op1_html_text,
    "op2_mixing": mixing.op2_mixing,
    "op3_near_dup": near_dup.op3_near_dup,
    "op4_embed_dup": embed_dup.op4_embed_dup,
    "op5_pii": pii.op5_pii,
    "op6_fingerprint": fingerprint.op6_fingerprint,
    "op7_lang_id": lang_id.op7_lang_id,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_pieces": pieces.op9_pieces,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_merkle": merkle.op11_merkle,
    "op12_lm_scores": ngram_lm.op12_lm_scores,
    "op13_periodic_runs": runs.op13_periodic_runs,
}
ORACLE_SQL = {
    "op2_mixing": mixing.OP2_SQL,
    "op3_near_dup": near_dup.OP3_SQL,
    "op4_embed_dup": embed_dup.OP4_SQL,
    "op8_suffix_dedup": suffix_dedup.OP8_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op12_lm_scores": ngram_lm.op12_lm_scores,
    "op13_periodic_runs": runs.OP13_SQL,
}
