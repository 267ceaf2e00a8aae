"""Named jobs over the supplied tables."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ["experience", "reserves", "pricing", "sheets", "quality", "features", "integration", "flows", "models"]


def load_queries():
    from .registry import QUERIES

    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
    return QUERIES
