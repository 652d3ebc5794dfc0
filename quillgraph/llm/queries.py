"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import byte_bpe, chat, embedding_dedup, lang_id, minhash_dedup, mixing, quality_classifier, quality_rules, secrets, token_files

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_token_files": token_files.op5_token_files,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_chat_format": chat.op7_chat_format,
    "op8_language_id": lang_id.op8_language_id,
    "op9_minhash_dedup": minhash_dedup.op9_minhash_dedup,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
}

ORACLES = {
    "op4_mix_sources": mixing.OP4_SQL,
    "op7_chat_format": chat.OP7_SQL,
}
