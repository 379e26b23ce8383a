"""Queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from tideline.llm import byte_bpe, chat_format, exact_dedup, hard_negatives, jaccard_join, language_id, license_scan, line_dedup, lm_score, packing, quality_rules, source_audit, warc


def queries() -> dict:
    return {
        "op1_jaccard_join": jaccard_join.op1_jaccard_join,
        "op2_packing": packing.op2_packing,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_chat_format": chat_format.op4_chat_format,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_byte_bpe": byte_bpe.op6_byte_bpe,
        "op7_language_id": language_id.op7_language_id,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_warc": warc.op9_warc,
        "op10_lm_score": lm_score.op10_lm_score,
        "op11_source_audit": source_audit.op11_source_audit,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_license_scan": license_scan.op13_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat_format": chat_format.ORACLE_SQL,
        "op5_exact_dedup": exact_dedup.ORACLE_SQL,
        "op8_line_dedup": line_dedup.ORACLE_SQL,
        "op9_warc": warc.ORACLE_SQL,
        "op11_source_audit": source_audit.ORACLE_SQL,
        "op12_hard_negatives": hard_negatives.ORACLE_SQL,
        "op13_license_scan": license_scan.ORACLE_SQL,
    }
