"""Operators for preparing training text; nothing outside this subpackage imports it."""

from __future__ import annotations

import importlib

#: Modules with QUERIES and SQL, in the order of the problems.
_NAMES = ["neardup_queries", "emails_queries", "scans_queries", "pieces_queries", "names_queries", "tokens_queries", "packing_queries", "pii_queries"]


def query_modules() -> list:
    return [importlib.import_module(f"{__name__}.{name}") for name in _NAMES]
