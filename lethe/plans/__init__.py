"""Registered queries, one module per group."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
