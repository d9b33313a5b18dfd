"""Named queries over the driver tables, and the SQL each is checked against."""

from __future__ import annotations

from importlib import import_module

MODULES = ("evaluation", "text_queries", "sampling_queries", "join_queries", "system_queries", "assembly_queries", "serving_queries", "converter_queries")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"{__package__}.{m}").ORACLE.items()}
