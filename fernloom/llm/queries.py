"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from fernloom.llm import decontam, fim, langid, lexical, linededup, matroska, maxent, pii, quotes, reshard, simhash, spm, urlfilter

QUERIES = {
    "op1_quotation_linking": quotes.op1_quotation_linking,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_min_cost_flow_reshard": reshard.op3_min_cost_flow_reshard,
    "op4_matroska": matroska.op4_matroska,
    "op5_url_filter": urlfilter.op5_url_filter,
    "op6_pii_spans": pii.op6_pii_spans,
    "op7_sentencepiece": spm.op7_sentencepiece,
    "op8_language_id": langid.op8_language_id,
    "op9_lsa_decontamination": decontam.op9_lsa_decontamination,
    "op10_line_dedup": linededup.op10_line_dedup,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_maxent_scores": maxent.op12_maxent_scores,
    "op13_ranked_search": lexical.op13_ranked_search,
    "quote_free_chats": quotes.quote_free_chats,
    "quoted_threads": quotes.quoted_threads,  # op1 on replies that quote: the table itself holds no quotes
}
ORACLE_SQL = {
    "op1_quotation_linking": quotes.OP1_SQL,
    "op5_url_filter": urlfilter.OP5_SQL,
    "op10_line_dedup": linededup.OP10_SQL,
    "op11_fill_in_middle": fim.OP11_SQL,
    "op13_ranked_search": lexical.OP13_SQL,
    "quote_free_chats": quotes.CHATS_SQL,
    "quoted_threads": quotes.QUOTED_THREADS_SQL,
}
