"""Registered queries."""

from __future__ import annotations

import importlib

MODULES = ["world", "gaps", "geometry", "raster", "matching", "benchmark", "graph", "sources", "plans"]


def load_all() -> None:
    """Import every query module so that it registers its queries."""
    for name in MODULES:
        importlib.import_module(f"craterline.queries.{name}")
