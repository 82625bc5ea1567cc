"""Registered queries of this subpackage, and their SQL where SQL can state them."""

from __future__ import annotations

from folioflow.llm import decontaminate, fill_middle, hard_negatives, language_id, media, near_dups, quality_rules, secrets, sentencepiece_codec, sharding, substring_dedup, toxicity, url_rules

QUERIES = {
    "op1_url_rules": url_rules.op1,
    "op2_sharding": sharding.op2,
    "op3_language_id": language_id.op3,
    "op4_sentencepiece": sentencepiece_codec.op4,
    "op5_secrets": secrets.op5,
    "op6_decontaminate": decontaminate.op6,
    "op7_media": media.op7,
    "op8_substring_dedup": substring_dedup.op8,
    "op9_near_dups": near_dups.op9,
    "op10_toxicity": toxicity.op10,
    "op11_quality_rules": quality_rules.op11,
    "op12_hard_negatives": hard_negatives.op12,
    "op13_fill_middle": fill_middle.op13,
}

ORACLES: dict[str, str] = {
    "op2_sharding": sharding.op2_sql(),
    "op11_quality_rules": quality_rules.op11_sql(),
    "op12_hard_negatives": hard_negatives.op12_sql(),
    "op13_fill_middle": fill_middle.op13_sql(),
}
