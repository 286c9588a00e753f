"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import (
    bbit_minhash, chat, collocations, decontaminate, fertility, filter_audit, jaccard, langid, line_dedup, mixing, suffix_dedup,
    url_filter, warc,
)

QUERIES = {
    "op1_mix_to_targets": mixing.query,
    "op2_line_dedup": line_dedup.query,
    "op3_fertility_rules": fertility.query,
    "op4_language_id": langid.query,
    "op5_suffix_dedup": suffix_dedup.query,
    "op6_jaccard_components": jaccard.query,
    "op7_decontaminate": decontaminate.query,
    "op8_url_filter": url_filter.query,
    "op9_warc_round_trip": warc.query,
    "op10_quotation_linking": chat.query,
    "op11_phrase_collocations": collocations.query,
    "op12_filter_audit": filter_audit.query,
    "op13_bbit_minhash": bbit_minhash.query,
}

ORACLE_SQL = {
    "op1_mix_to_targets": mixing.SQL,
    "op2_line_dedup": line_dedup.SQL,
    "op6_jaccard_components": jaccard.SQL,
    "op11_phrase_collocations": collocations.SQL,
    "op12_filter_audit": filter_audit.SQL,
    "op13_bbit_minhash": bbit_minhash.SQL,
}
