"""Registered queries, grouped by family."""

from __future__ import annotations

import importlib

FAMILIES = ("trees", "relational", "ingest", "graphs", "quality", "searching", "normalise", "lines")


def load_plans():
    from factline.plans.registry import PLANS

    for name in FAMILIES:
        importlib.import_module(f"factline.plans.{name}")
    return PLANS
