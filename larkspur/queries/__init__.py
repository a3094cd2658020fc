"""Queries over the test tables, one or more for each operator, each beside its SQL."""

from __future__ import annotations

import importlib

MODULES = ("labels", "splits", "joins", "metrics", "decoders", "sweeps", "sampling", "stats", "routing", "lexical", "records", "tables", "sources", "extensions")


def load():
    """(queries, SQL) of all modules."""
    from larkspur.queries.registry import ORACLES, QUERIES

    for name in MODULES:
        importlib.import_module(f"larkspur.queries.{name}")
    return dict(QUERIES), dict(ORACLES)
