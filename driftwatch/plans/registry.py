"""Registry of the operator queries (``queries()``) and DuckDB oracles."""
from __future__ import annotations

import importlib

AREAS = ["q_signals", "q_graph", "q_model", "q_link", "q_alerts", "q_eval", "q_ml", "q_reports", "q_sources", "q_extra"]


def _modules():
    return [importlib.import_module(f"driftwatch.plans.{a}") for a in AREAS]


def all_queries() -> dict:
    out: dict = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def all_oracles() -> dict:
    out: dict = {}
    for m in _modules():
        out.update(getattr(m, "ORACLES", {}))
    q = all_queries()
    return {k: v for k, v in out.items() if k in q}
