"""Registered queries of the operators, and their SQL where it can express them."""

from __future__ import annotations

from lintlake.llm import (
    decontamination, licenses, line_rules, line_runs, lm_scoring, packing, personal, quality, sharding, simhash,
    token_counts, variants, whitening)

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1_lm_scoring,
    "op3_sharding": sharding.op3_sharding,
    "op4_packing": packing.op4_packing,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_quality": quality.op6_quality,
    "op9_personal_data": personal.op9_personal_data,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_simhash": simhash.op8_simhash,
    "op10_line_quality": line_rules.op10_line_quality,
    "op2_token_counts": token_counts.op2_token_counts,
    "op11_whitening": whitening.op11_whitening,
    "op12_line_dedup": line_runs.op12_line_dedup,
    "op13_spelling_variants": variants.op13_spelling_variants,
}
ORACLE = {
    "op10_line_quality": line_rules.OP10_SQL,
    "op12_line_dedup": line_runs.OP12_SQL,
}
