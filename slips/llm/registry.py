"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from . import (
    bpe,
    conversations,
    decontam,
    exact_dedup,
    language,
    licenses,
    lm,
    near,
    negatives,
    pii,
    quality,
    sharding,
    simhash,
)

MODULES = [pii, bpe, sharding, licenses, exact_dedup, decontam, language, lm, quality, near, conversations, negatives, simhash]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
