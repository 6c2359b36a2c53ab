"""Loads every module that registers queries."""

from __future__ import annotations

import importlib
import pkgutil

import voxloom.plans


def load_all() -> None:
    for module in sorted(m.name for m in pkgutil.iter_modules(voxloom.plans.__path__)):
        if module.startswith("queries_"):
            importlib.import_module(f"voxloom.plans.{module}")
