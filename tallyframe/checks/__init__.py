"""Registered queries over the driver tables, one module per operator family."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every check module and return (queries, oracle SQL)."""
    from tallyframe.checks.registry import ORACLE, QUERIES

    for mod in pkgutil.iter_modules(__path__):
        if mod.name.startswith("check_"):
            importlib.import_module(f"{__name__}.{mod.name}")
    return QUERIES, ORACLE
