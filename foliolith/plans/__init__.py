"""Catalogued queries with their oracle SQL."""

from __future__ import annotations

import importlib

#: Modules that register core queries.
MODULES = ("nested", "compare", "scalars", "matching", "outline", "parse", "assemble", "edits", "figures", "io", "reviews")


def load_core() -> tuple[dict, dict]:
    """Import every module of core queries; give the queries and their SQL."""
    from foliolith.plans import catalog

    for name in MODULES:
        importlib.import_module(f"foliolith.plans.{name}")
    return catalog.QUERIES, catalog.ORACLE
