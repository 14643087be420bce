"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from fleetquery.llm import bpe, chat, exact_dedup, fingerprints, language_id, packing, pii, sharding, simhash, token_store

QUERIES = {
    "op1_token_store": token_store.op1_token_store,
    "op2_pii": pii.op2_pii,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_language_id": language_id.op4_language_id,
    "op5_simhash": simhash.op5_simhash,
    "op6_sharding": sharding.op6_sharding,
    "op7_bpe": bpe.op7_bpe,
    "op8_chat_format": chat.op8_chat_format,
    "op9_packing": packing.op9_packing,
    "op10_fingerprints": fingerprints.op10_fingerprints,
}

ORACLE_SQL = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op6_sharding": sharding.OP6_SQL,
    "op8_chat_format": chat.OP8_SQL,
}
