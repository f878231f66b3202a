"""Queries on the given tables."""

from __future__ import annotations

import importlib
import pkgutil
import sys


def load():
    """Import every query module once and return the registry."""
    for module in pkgutil.iter_modules(sys.modules[__name__].__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
    return importlib.import_module(f"{__name__}.catalog")
