"""Registered queries, one module per family."""

from importlib import import_module
from pkgutil import iter_modules

from marketloom.plans.registry import ORACLES, QUERIES

for _m in sorted(m.name for m in iter_modules(__path__) if m.name.endswith("_queries")):
    import_module(f"{__name__}.{_m}")

__all__ = ["QUERIES", "ORACLES"]
