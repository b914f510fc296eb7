"""All registered queries by name, each with the SQL it is compared with."""

from __future__ import annotations

from . import dialogues, evaluation, events, knowledge, relational, sources, text, tokens
from .base import ORACLES, QUERIES

_ = (text, dialogues, knowledge, evaluation, tokens, events, relational, sources)


def FLAGSHIP(spark, sf_dir):
    return QUERIES["filter_reject_reason"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
