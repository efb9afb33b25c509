"""Named query plans over the driver tables."""

from __future__ import annotations

import importlib

AREAS = ["medallion", "published", "reconcile", "governance", "trend", "search", "responses", "landed", "upkeep", "provenance", "limits", "streams", "stores", "tools"]


def load_catalog():
    """Import every area once; each registers its queries."""
    from tidemark.plans.catalog import CATALOG

    for area in AREAS:
        importlib.import_module(f"tidemark.plans.{area}")
    return CATALOG
