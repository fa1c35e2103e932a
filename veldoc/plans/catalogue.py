"""All queries over the given tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import importlib
import pkgutil

from veldoc import plans


def _modules():
    return [importlib.import_module(f"veldoc.plans.{m.name}") for m in pkgutil.iter_modules(plans.__path__) if m.name.startswith("q_")]


def queries() -> dict:
    return {name: f for m in _modules() for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, (_, sql) in m.QUERIES.items() if sql}
