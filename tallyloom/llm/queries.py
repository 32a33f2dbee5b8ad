"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from tallyloom.llm import chat_format, collocations, fm_quality, gif, html_text, language_id, mixing, near_dup, packing, quality_rules, secrets_scan, toxicity, turn_repair

QUERIES = {
    "op1_quality_fm": fm_quality.query,
    "op2_quality_rules": quality_rules.query,
    "op3_best_two_fit": packing.query,
    "op4_language_id": language_id.query,
    "op5_html_text": html_text.query,
    "op6_toxicity": toxicity.query,
    "op7_secrets": secrets_scan.query,
    "op8_mix_sources": mixing.query,
    "op9_gif": gif.query,
    "op10_near_dup": near_dup.query,
    "op11_collocations": collocations.query,
    "op12_chat_format": chat_format.query,
    "op13_turn_repair": turn_repair.query,
}
ORACLES = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op8_mix_sources": mixing.ORACLE,
    "op10_near_dup": near_dup.ORACLE,
    "op11_collocations": collocations.ORACLE,
}
