"""The queries of this subpackage, one module an operator."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("quality", "languages", "substrings", "licenses", "mixing", "neardup", "bytebpe", "pseudolm", "urls", "exact_dedup", "conversations", "alignment", "tokencounts")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"lectern.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
