"""Every query of the engine's own operators with the SQL that checks it."""

from __future__ import annotations

from slips.plans import queries_forms, queries_pages, queries_parts, queries_receipts, queries_rules

MODULES = [queries_receipts, queries_parts, queries_rules, queries_pages, queries_forms]


def flagship(spark, sf_dir):
    return queries_receipts.api2_receipts(spark, sf_dir)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
