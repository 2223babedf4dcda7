"""All core queries and the statements they are checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["problems", "problem_sql", "series", "readings", "peers", "scalars", "workbench", "facts", "texts", "batches", "manifests", "stream"]


def collect() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    queries, oracles = {}, {}
    for name in MODULES:
        try:
            module = importlib.import_module(f"seriesloom.plans.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"seriesloom.plans.{name}":
                raise
            continue
        queries |= getattr(module, "QUERIES", {})
        oracles |= getattr(module, "ORACLES", {})
    return queries, oracles
