"""All registered queries over the test tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_pages, q_projections, q_tables

MODULES = (q_projections, q_tables, q_pages)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship_hosts"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
