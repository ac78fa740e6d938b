"""All registered queries of the library proper."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("search", "storing", "filing", "coding", "texts", "judging", "streams", "details")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["hybrid_search"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(f"tessera.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"tessera.plans.{m}").ORACLE.items()}
