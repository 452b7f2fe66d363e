"""The queries by name with their SQL, and how a rule is made one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import rules
from . import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function by its name, with its SQL."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def run_rule(spark: SparkSession, d: str, rule: str, thresholds: dict | None = None, **tables: DataFrame) -> DataFrame:
    """One rule of the catalogue over the given tables, through the engine."""
    ctx = rules.Context({"files": adapters.files(spark, d), **tables}, thresholds={rule: thresholds or {}})
    found, failed = rules.execute(ctx, rules.Registry(tuple(r for r in rules.RULES if r.id == rule)))
    if failed:
        raise RuntimeError(failed)
    return found.select("id", "rule_id", "severity", "file", "line", "description")


def told(rule: str, severity: str, file: str, line: str, description: str) -> str:
    return f"sha256('{rule}:' || {file} || ':' || {line} || ':' || {description}) AS id, '{rule}' AS rule_id, '{severity}' AS severity, {file} AS file, {line}::INTEGER AS line, {description} AS description"
