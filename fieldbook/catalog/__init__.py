"""Registered queries, one per operator, over the driver's tables."""

from __future__ import annotations

import importlib

from fieldbook.catalog.registry import ORACLES, QUERIES

MODULES = ["places", "inputs", "values", "totals", "time", "links", "papers", "signals"]


def load_all():
    """Import every catalog module and return (queries, oracles)."""
    for m in MODULES:
        importlib.import_module(f"fieldbook.catalog.{m}")
    return dict(QUERIES), dict(ORACLES)
