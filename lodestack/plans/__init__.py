"""Registered queries of the catalogue engine."""

from __future__ import annotations

from importlib import import_module

MODULES = ("decisions", "relational", "workflow", "extraction", "metadata", "search", "repositories", "streams")


def load() -> dict:
    """name -> (query, oracle SQL or None) of all modules."""
    for m in MODULES:
        import_module(f"lodestack.plans.{m}")
    from lodestack.plans.base import REGISTRY

    return REGISTRY
