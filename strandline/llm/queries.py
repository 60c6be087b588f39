"""The operators' queries and their SQL."""

from __future__ import annotations

from . import conversations, decontamination, embeddings, html_text, language, lines, mixing, near, pii, secrets, spelling, toxicity, urls

QUERIES = {
    "op1_url_filter": urls.op1_url_filter,
    "op2_pii": pii.op2_pii,
    "op3_near_duplicates": near.op3_near_duplicates,
    "op4_mixing": mixing.op4_mixing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_secrets": secrets.op6_secrets,
    "op7_language": language.op7_language,
    "op8_lines": lines.op8_lines,
    "op9_html_text": html_text.op9_html_text,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_conversation_trie": conversations.op11_conversation_trie,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_embedding_duplicates": embeddings.op13_embedding_duplicates,
}

SQL = {
    "op3_near_duplicates": near.SQL,
    "op4_mixing": mixing.SQL,
    "op6_secrets": secrets.SQL,
    "op8_lines": lines.SQL,
    "op10_decontamination": decontamination.SQL,
    "op11_conversation_trie": conversations.SQL,
    "op12_spelling_variants": spelling.SQL,
    "op13_embedding_duplicates": embeddings.SQL,
}
