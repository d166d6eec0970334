"""Registered queries, grouped by theme."""

from __future__ import annotations

import importlib

THEMES = ("bar_windows", "labels", "screener", "patterns", "ledger", "studies", "panel", "documents", "notes", "streams", "surface")


def catalogue():
    """Every registered query by name."""
    from tapeloom.plans.registry import REGISTRY

    for theme in THEMES:
        importlib.import_module(f"tapeloom.plans.{theme}")
    return REGISTRY
