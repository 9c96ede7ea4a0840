"""All named queries, gathered from the modules that define them."""

from __future__ import annotations

import importlib

from gravitas.plans.registry import ORACLES, QUERIES, Query

MODULES = ["table_queries", "profile_queries", "prepare_queries", "model_queries"]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"gravitas.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
