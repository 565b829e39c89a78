"""The registered queries over the given tables."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every query module and return the registry."""
    from pelagia.workload import registry

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module.startswith("queries_"):
            importlib.import_module(f"{__name__}.{module}")
    return registry
