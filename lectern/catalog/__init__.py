"""Queries over the given tables, each with its SQL twin where SQL can state it."""

from lectern.catalog.registry import ORACLES, QUERIES


def load() -> None:
    """Import the modules that register queries."""
    from importlib import import_module
    from pkgutil import iter_modules

    for m in iter_modules(__path__):
        if m.name.endswith("_queries"):
            import_module(f"{__name__}.{m.name}")


__all__ = ["ORACLES", "QUERIES", "load"]
