"""Names of all queries outside the training-data subpackage, and their SQL for DuckDB."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
PLANS = ["runs", "texts", "leaks", "policy", "upkeep", "bodies", "fields", "reports", "assembly", "shell", "gates", "lines", "keeping", "redaction", "matching"]


def query(name: str, oracle: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def _load() -> None:
    for plan in PLANS:
        importlib.import_module(f"turnlake.plans.{plan}")


def queries() -> dict:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLE


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["ca7_daily_report"](spark, sf_dir)
