"""The queries of this subpackage and their SQL.

Languages, pages, licenses, shards, toxicity and SimHash have no SQL: their
tests hold them against brute force, exact round trips or held-out rows.
"""

from . import chat, decontam, fim, html_text, langid, licenses, minhash, mixing, negatives, quality, sharding, simhash, toxicity

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_language_id": langid.op2_language_id,
    "op3_decontaminate": decontam.op3_decontaminate,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_html_text": html_text.op5_html_text,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_reshard": sharding.op7_reshard,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_minhash_near_dedup": minhash.op13_minhash_near_dedup,
}
ORACLE_SQL = {
    "op1_chat_format": chat.OP1_SQL,
    "op3_decontaminate": decontam.OP3_SQL,
    "op4_quality_rules": quality.OP4_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
    "op11_fill_in_middle": fim.OP11_SQL,
    "op12_hard_negatives": negatives.OP12_SQL,
    "op13_minhash_near_dedup": minhash.OP13_SQL,
}
