"""Registered queries, their inputs and the SQL that states their results."""
from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every ``q_*`` module, which registers its queries."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")
