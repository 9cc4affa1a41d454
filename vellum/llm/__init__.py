"""Operators for training-data pipelines, and their queries."""

from __future__ import annotations

from . import license, linededup, media, mixing, packing, quality, simhash, tokencount, toxicity, urlfilter

QUERIES = {
    "op1_toxicity_pu": toxicity.op1_toxicity_pu,
    "op2_media_tar": media.op2_media_tar,
    "op3_url_shift_and": urlfilter.op3_url_shift_and,
    "op4_prefix_tokens": tokencount.op4_prefix_tokens,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_license_scan": license.op6_license_scan,
    "op7_simhash_ball": simhash.op7_simhash_ball,
    "op8_line_winnow": linededup.op8_line_winnow,
    "op9_repetition_rules": quality.op9_repetition_rules,
    "op10_source_mix": mixing.op10_source_mix,
}

ORACLES = {"op3_url_shift_and": urlfilter.OP3_SQL, "op6_license_scan": license.oracle_sql(), "op8_line_winnow": linededup.oracle_sql(), "op9_repetition_rules": quality.oracle_sql()}
