"""Operators for training-data pipelines. Nothing outside this folder imports it; ``__spark_entry__`` adds its queries."""

from __future__ import annotations

from . import bpe, decontamination, filter_audit, hard_negatives, jaccard, licenses, line_dedup, mixing, quality_rules, resampling, suffix_dedup, token_counts, token_files

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_benchmark_decontamination": decontamination.op2_benchmark_decontamination,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_token_files": token_files.op5_token_files,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_importance_resampling": resampling.op8_importance_resampling,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_bpe_round_trip": bpe.op13_bpe_round_trip,
}
ORACLE_SQL = {**line_dedup.ORACLE_SQL, **suffix_dedup.ORACLE_SQL, **mixing.ORACLE_SQL, **quality_rules.ORACLE_SQL, **jaccard.ORACLE_SQL, **filter_audit.ORACLE_SQL, **hard_negatives.ORACLE_SQL}
