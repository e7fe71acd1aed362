"""Query catalogue: each module registers the queries of one operator family."""
from __future__ import annotations

from importlib import import_module

FAMILIES = ("scoring", "recoding", "banding", "splitting", "neighbours", "spatial", "cataloguing", "edges")


def load_queries():
    from . import registry
    for name in FAMILIES:
        import_module(f"{__name__}.{name}")
    return registry.QUERIES, registry.SQL
