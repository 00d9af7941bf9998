"""Queries of this subpackage, by name, and the SQL that DuckDB can check them with."""

from __future__ import annotations

from strandlake.llm import chat_format, exact_dedup, html_text, line_dedup, packing, quality_net, quality_rules, simhash, token_files, tokens

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_bpe_codec": tokens.op3_bpe_codec,
    "op4_packing": packing.op4_packing,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_simhash": simhash.op7_simhash,
    "op8_html_text": html_text.op8_html_text,
    "op9_quality_classifier": quality_net.op9_quality_classifier,
    "op10_token_files": token_files.op10_token_files,
}
ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op6_chat_format": chat_format.ORACLE,
}
