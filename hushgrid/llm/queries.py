"""The queries of this package, by name, and their SQL."""

from __future__ import annotations

from hushgrid.llm import chat, decontam, langid, lm, packing, quality, sharding, simhash, substring_dedup, tokenio

QUERIES = {
    "op1_best_fit_packing": packing.op1,
    "op2_language_id": langid.op2,
    "op3_substring_dedup": substring_dedup.op3,
    "op4_chat_formatting": chat.op4,
    "op5_token_binary": tokenio.op5,
    "op6_quality_rules": quality.op6,
    "op7_simhash_near_dedup": simhash.op7,
    "op8_sharding": sharding.op8,
    "op9_decontamination": decontam.op9,
    "op10_lm_scoring": lm.op10,
}

ORACLE_SQL = {
    "op4_chat_formatting": chat.OP4_SQL,
    "op6_quality_rules": quality.OP6_SQL,
    "op8_sharding": sharding.OP8_SQL,
    "op10_lm_scoring": lm.OP10_SQL,
}
