"""Imports every plan module, which registers its queries."""

from __future__ import annotations

import importlib

MODULES = ("ingest", "columns", "windows", "scenarios", "portfolios", "regimes", "causality", "forecasts", "streams")


def load():
    from tidewise.registry import REGISTRY

    for m in MODULES:
        importlib.import_module(f"tidewise.plans.{m}")
    return REGISTRY
