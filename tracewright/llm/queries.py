"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tracewright.llm import alignment, chat, decontamination, langid, merkle, mixing, quality, sentencepiece_codec, sharding, simhash, suffix_dedup, token_output, toxicity

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_simhash": simhash.op2_simhash,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_token_output": token_output.op5_token_output,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_sentencepiece": sentencepiece_codec.op8_sentencepiece,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_sharding": sharding.op10_sharding,
    "op11_cross_tokenizer": alignment.op11_cross_tokenizer,
    "op12_merkle": merkle.op12_merkle,
    "op13_mixing": mixing.op13_mixing,
}
ORACLES = {"op6_chat_formatting": chat.OP6_SQL, "op7_quality_rules": quality.OP7_SQL, "op12_merkle": merkle.OP12_SQL, "op13_mixing": mixing.OP13_SQL}
