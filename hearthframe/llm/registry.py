"""The queries of the corpus operators, and their SQL counterparts where SQL can express them."""

from __future__ import annotations

from hearthframe.llm import chat, clustering, decontam, digest, language, lexical, lineruns, mixing, pagetext, quality, simhash, tokens


def queries() -> dict:
    return {"op1_source_mix": mixing.op1, "op2_simhash": simhash.op2, "op3_language": language.op3, "op4_token_counts": tokens.op4, "op5_html_text": pagetext.op5, "op6_token_file": tokens.op6, "op7_fingerprints": digest.op7, "op8_line_runs": lineruns.op8, "op9_decontam": decontam.op9, "op10_chat_format": chat.op10, "op11_lexical_search": lexical.op11, "op12_centroids": clustering.op12, "op13_quality_rules": quality.op13}


def oracle_sql() -> dict[str, str]:
    return {"op10_chat_format": chat.OP10_SQL, "op11_lexical_search": lexical.OP11_SQL, "op12_centroids": clustering.OP12_SQL, "op13_quality_rules": quality.OP13_SQL}
