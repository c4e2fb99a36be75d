"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import byte_bpe, chat, decontaminate, language_id, mixing, near_dup, ranked_search, suffix_dedup, telephony, toxicity, url_filters, vector_codes, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_telephony": telephony.op2_telephony,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_warc_archive": warc.op4_warc_archive,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_chat_format": chat.op6_chat_format,
    "op7_near_dup": near_dup.op7_near_dup,
    "op8_url_filter": url_filters.op8_url_filter,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_language_id": language_id.op10_language_id,
    "op11_byte_bpe": byte_bpe.op11_byte_bpe,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}

SQL = {
    "op4_warc_archive": warc.OP4_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op8_url_filter": url_filters.OP8_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
    "op13_ranked_search": ranked_search.OP13_SQL,
}
