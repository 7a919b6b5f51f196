"""Registered queries."""

from __future__ import annotations

import importlib

#: Modules of this package that hold a registry ``R``.
MODULES = ("corpus", "relational", "mobility", "spatial", "places", "tables")


def all_registries():
    for name in MODULES:
        yield importlib.import_module(f"{__name__}.{name}").R
