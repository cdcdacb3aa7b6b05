"""Names, queries and oracle SQL of the library's own operators.

``query`` registers a plain ``DataFrame(s) -> DataFrame`` function under its name: the query calls it on the adapters' tables, the
oracle is DuckDB SQL over the same adapters as common table expressions.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from qaspark.sources.adapters import ADAPTERS, duck_ctes, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Modules that register operators when they are imported.
MODULES = """operators.results operators.metrics operators.validation operators.rewards operators.cases operators.knowledge
 operators.vectors operators.chunking operators.endpoints operators.specification operators.validators operators.datagen
 operators.assertions operators.responses operators.sourcecode operators.reports operators.context streaming.jobs plans.workloads""".split()


def query(*tables: str, sql: str | None = None, name: str | None = None, prepare: Callable | None = None):
    """Register the decorated function on the named tables. ``prepare`` may turn the tables into other arguments."""

    def register(f):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            inputs = [load(spark, sf_dir, t) for t in tables]
            return f(*(prepare(*inputs) if prepare else inputs))

        QUERIES[key] = run
        if sql:
            ORACLE_SQL[key] = duck_ctes([t for t in tables if t in ADAPTERS], sql)
        return f

    return register


def load_all() -> None:
    """Import every module that registers operators."""
    for m in MODULES:
        importlib.import_module(f"qaspark.{m}")
