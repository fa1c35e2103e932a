"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import importlib

#: Query and module of each operator.
_OPERATORS = {
    "op1_nearest": "nearest",
    "op2_chat": "chat",
    "op3_licenses": "licenses",
    "op4_urls": "urls",
    "op5_decontaminate": "decontaminate",
    "op6_quality": "quality",
    "op7_passages": "passages",
    "op8_secrets": "secrets",
    "op9_near_dups": "near_dups",
    "op10_bpe": "bpe",
}


def _query(module: str, name: str):
    def run(spark, sf_dir: str):
        return getattr(importlib.import_module(module), name)(spark, sf_dir)

    return run


def queries() -> dict:
    found = {name: _query(f"veldoc.llm.{module}", name) for name, module in _OPERATORS.items()}
    return found | {"pipeline": _query("corpus_pipeline", "run")}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"veldoc.llm.{module}"), "ORACLE", None) for name, module in _OPERATORS.items()}
    return {name: sql for name, sql in found.items() if sql}
