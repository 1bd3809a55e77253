"""Registered queries over the given tables; importing the modules fills the registry."""

from __future__ import annotations

import importlib
import pkgutil

from ..plans import registry


def load():
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module != "sql":
            importlib.import_module(f"{__name__}.{module}")
    return registry
