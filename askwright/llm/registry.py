"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("exact_dedup", "sharding", "url_filter", "decontaminate", "quality", "toxicity", "packing", "near_dup", "suffix_dedup", "lm_score", "divergence", "resample", "pii")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"{__package__}.{m}").ORACLE.items()}
