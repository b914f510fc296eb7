"""Queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from . import (
    chat_format,
    decontamination,
    fingerprints,
    line_dedup,
    mixing,
    ngram_join,
    quality_classifier,
    secret_scan,
    substring_dedup,
    token_output,
)

_MODULES = {
    "op1_ngram_join": ngram_join,
    "op2_secret_scan": secret_scan,
    "op3_line_dedup": line_dedup,
    "op4_quality_classifier": quality_classifier,
    "op5_decontaminate": decontamination,
    "op6_mix_sources": mixing,
    "op7_token_output": token_output,
    "op8_fingerprints": fingerprints,
    "op9_substring_dedup": substring_dedup,
    "op10_chat_format": chat_format,
}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module in _MODULES.items() if getattr(module, "ORACLE", None)}
