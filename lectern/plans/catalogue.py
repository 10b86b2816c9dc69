"""All queries of the core library with their SQL equivalents."""

from __future__ import annotations

import importlib

FAMILIES: tuple[str, ...] = ("sampling", "preparation", "scores", "reviews", "lexica", "policies", "spans", "splitting", "scans", "inventory", "validation", "models", "intake", "integrity", "suggestions", "archives")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _family in FAMILIES:
    _module = importlib.import_module(f"lectern.plans.{_family}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
