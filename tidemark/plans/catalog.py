"""Importing this module registers every query."""

from importlib import import_module

from .registry import ORACLES, QUERIES

MODULES = ("joins", "scalars", "aggregates", "windows", "events", "book", "infer", "flow", "equities", "quality", "sources", "streaming")
for _name in MODULES:
    import_module(f"{__package__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
