"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from foliant.llm import bpe, conversations, decontaminate, divergence, fingerprints, html_text, language, line_dedup, ngram_join, packing, ppm, quality, token_files

QUERIES = {
    "op1_language": language.op1_language,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_quality": quality.op3_quality,
    "op4_html_text": html_text.op4_html_text,
    "op5_ppm": ppm.op5_ppm,
    "op6_bpe": bpe.op6_bpe,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_token_files": token_files.op10_token_files,
    "op11_source_audit": divergence.op11_source_audit,
    "op12_packing": packing.op12_packing,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

ORACLE_SQL = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op11_source_audit": divergence.ORACLE,
}
