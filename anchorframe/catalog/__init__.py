"""Registered queries with their check SQL, by theme."""

from importlib import import_module

from anchorframe.catalog.base import ORACLES, QUERIES

THEMES = ("events", "expressions", "joins", "tables", "profiles", "sampling", "distributions", "models", "mixed", "spatial", "plans", "sources")
for _theme in THEMES:
    import_module(f"anchorframe.catalog.{_theme}")

__all__ = ["ORACLES", "QUERIES"]
