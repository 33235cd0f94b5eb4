"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import alignment, decontaminate, hard_negatives, license_scan, line_dedup, mixing, near_dedup, packing, pii, quality_model, quality_rules, secret_scan, token_counts

QUERIES = {
    "op1_poisson_mixing": mixing.query,
    "op2_delta_token_counts": token_counts.query,
    "op3_attention_quality": quality_model.query,
    "op4_decision_list_quality": quality_rules.query,
    "op5_minhash_near_dedup": near_dedup.query,
    "op6_winnowing_decontamination": decontaminate.query,
    "op7_line_alignment_dedup": line_dedup.query,
    "op8_multipart_secrets": secret_scan.query,
    "op9_deobfuscating_pii": pii.query,
    "op10_license_classifier": license_scan.query,
    "op11_vantage_point_negatives": hard_negatives.query,
    "op12_event_sweep_alignment": alignment.query,
    "op13_pattern_packing": packing.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_poisson_mixing": mixing.ORACLE_SQL,
    "op5_minhash_near_dedup": near_dedup.ORACLE_SQL,
    "op6_winnowing_decontamination": decontaminate.ORACLE_SQL,
    "op11_vantage_point_negatives": hard_negatives.ORACLE_SQL,
}
