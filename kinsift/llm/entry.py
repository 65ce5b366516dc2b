"""Queries and oracle SQL of this subpackage, for the driver's entry module."""

from __future__ import annotations

from kinsift.llm import audio, bpe, cleaning, mixing, quality, sharding, simhash, substring, toxicity, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_quality": quality.op3_quality,
    "op4_sharding": sharding.op4_sharding,
    "op5_substring": substring.op5_substring,
    "op6_warc": warc.op6_warc,
    "op7_quality_rules": cleaning.op7_quality_rules,
    "op8_mixing": mixing.op8_mixing,
    "op9_audio": audio.op9_audio,
    "op10_bpe": bpe.op10_bpe,
}

SQL: dict[str, str] = {
    "op6_warc": warc.OP6_SQL,
    "op7_quality_rules": cleaning.OP7_SQL,
    "op8_mixing": mixing.OP8_SQL,
}
