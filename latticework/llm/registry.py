"""Queries of this package, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import chat_format, decontaminate, fill_in_middle, hard_negatives, language_id, license_scan, mixing, near_dedup, quality, secret_scan, substring_dedup, suffix_dedup, topk_search


def queries() -> dict:
    return {
        "op1_chat_format": chat_format.op1_chat_format,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_near_dedup": near_dedup.op4_near_dedup,
        "op5_topk_search": topk_search.op5_topk_search,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_mixing": mixing.op7_mixing,
        "op8_language_id": language_id.op8_language_id,
        "op9_secret_scan": secret_scan.op9_secret_scan,
        "op10_quality": quality.op10_quality,
        "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
        "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict:
    return {
        "op1_chat_format": chat_format.ORACLE,
        "op2_substring_dedup": substring_dedup.ORACLE,
        "op3_license_scan": license_scan.ORACLE,
        "op4_near_dedup": near_dedup.ORACLE,
        "op5_topk_search": topk_search.ORACLE,
        "op6_decontaminate": decontaminate.ORACLE,
        "op11_fill_in_middle": fill_in_middle.ORACLE,
        "op13_hard_negatives": hard_negatives.ORACLE,
    }
