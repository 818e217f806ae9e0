"""Whole queries: operators wired to tables, each with its SQL twin where one exists."""

from __future__ import annotations

import importlib

from pricetide.plans.registry import CATALOG, Query

_MODULES = ("q_history", "q_panel", "q_market", "q_linkage", "q_lifecycle", "q_value", "q_inspect", "q_stream")


def catalog() -> dict[str, Query]:
    for module in _MODULES:
        importlib.import_module(f"pricetide.plans.{module}")
    return dict(CATALOG)
