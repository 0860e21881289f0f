"""Whole evaluations, and the catalogue of named queries."""

from __future__ import annotations

from importlib import import_module

QUERY_MODULES = ("scores", "records", "pairs", "leaks", "people", "files", "sources", "streams")


def load_catalog():
    """All registered queries by name."""
    for module in QUERY_MODULES:
        import_module(f"tallymark.plans.queries_{module}")
    from tallymark.plans.catalog import CATALOG

    return CATALOG
