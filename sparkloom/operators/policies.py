"""Boundary policies: configuration, evaluation over resolved imports, findings.

A policy names source paths by globs and either the targets it allows or those it disallows. The policies are few, as a person
writes them, and become expressions over the import's two paths: an import is read once for all policies, and nothing is joined.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import key, policy_glob
from ..functions.metadata import metadata
from .resolve import resolve, with_re_exports
from .score import POLICY_RULE

# Severities, penalties and the preset.
SEVERITIES = ("info", "warning", "error")
SCORE_PENALTIES = {"error": 2.0, "info": 0.1, "warning": 0.5}
KEYS = ("allow", "description", "disallow", "enabled", "from", "id", "recommendation", "severity")
RECOMMENDATION = "Respect the documented module boundary or introduce a shared abstraction."
PRESETS = {
    "recommended": (
        {"id": "no-server-imports", "description": "UI modules must not import server modules directly.", "from": ["src/components/**", "src/app/**"], "disallow": ["src/server/**"], "severity": "error", "recommendation": "Move server logic behind an API or shared abstraction."},
    ),
}


class ConfigurationError(ValueError):
    """The policy configuration can't be used."""


@dataclass(frozen=True)
class Policy:
    id: str
    description: str
    sources: tuple[str, ...]
    severity: str
    allow: tuple[str, ...] | None = None
    disallow: tuple[str, ...] | None = None
    recommendation: str = RECOMMENDATION
    origin: str = "project"


@dataclass(frozen=True)
class Policies:
    policies: tuple[Policy, ...] = ()
    presets: tuple[str, ...] = ()
    penalties: dict[str, float] = field(default_factory=lambda: dict(SCORE_PENALTIES))
    source: str = "none"


def load(path: str | Path) -> Policies:
    """From a JSON file; one that isn't there means no policies."""
    try:
        text = Path(path).read_text(encoding="utf-8")
    except FileNotFoundError:
        return Policies()
    try:
        return configure(json.loads(text))
    except json.JSONDecodeError as e:
        raise ConfigurationError(f"{path}: {e}") from e


def configure(told: object) -> Policies:
    _need(isinstance(told, dict), "a configuration is a JSON object")
    _known(told, ("extends", "policies", "policyScore"))
    extends = told.get("extends", [])
    _need(isinstance(extends, list) and all(isinstance(x, str) for x in extends) and len({*extends}) == len(extends), "extends is a list of different preset names")
    unknown = [x for x in extends if x.rpartition(":")[2] not in PRESETS]
    _need(not unknown, f"unknown presets: {unknown}")
    rows = told.get("policies", [])
    _need(isinstance(rows, list), "policies is a list")
    merged = {p.id: p for x in extends for p in map(lambda d: _policy(d, "preset"), PRESETS[x.rpartition(":")[2]])}
    seen: set[str] = set()
    for row in rows:
        _need(isinstance(row, dict) and isinstance(row.get("id"), str) and bool(re.fullmatch(r"[a-z][a-z0-9-]*", row["id"])), "a policy has an id of lower-case letters, digits and hyphens")
        _need(row["id"] not in seen, f"two policies with the id {row['id']}")
        seen.add(row["id"])
        _known(row, KEYS)
        if row.get("enabled") is False:
            merged.pop(row["id"], None)
        else:
            merged[row["id"]] = _policy(row, "project")
    return Policies(tuple(merged[k] for k in sorted(merged)), tuple(extends), _penalties(told.get("policyScore")), "project")


def _policy(row: dict, origin: str) -> Policy:
    name = row["id"]
    _need(isinstance(row.get("description"), str) and row["description"] != "", f"{name}: a description is needed")
    globs = lambda x: isinstance(x, list) and bool(x) and all(isinstance(g, str) and g for g in x)
    _need(globs(row.get("from")), f"{name}: from is a list of patterns")
    _need(("allow" in row) != ("disallow" in row), f"{name}: either allow or disallow")
    _need(globs(row.get("allow", row.get("disallow"))), f"{name}: allow or disallow is a list of patterns")
    _need(row.get("severity") in SEVERITIES, f"{name}: severity is one of {SEVERITIES}")
    _need(isinstance(row.get("recommendation", ""), str), f"{name}: the recommendation is a text")
    side = lambda k: tuple(row[k]) if k in row else None
    return Policy(name, row["description"], tuple(row["from"]), row["severity"], side("allow"), side("disallow"), row.get("recommendation", RECOMMENDATION), origin)


def _penalties(told: object) -> dict[str, float]:
    if told is None:
        return dict(SCORE_PENALTIES)
    _need(isinstance(told, dict), "policyScore is an object")
    for k, v in told.items():
        _need(k in SEVERITIES and isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) and v >= 0, "policyScore has finite penalties of 0 or more by severity")
    return {k: float(v) for k, v in told.items()}


def _known(row: dict, keys: tuple[str, ...]) -> None:
    more = [k for k in row if k not in keys]
    _need(not more, f"unknown fields: {more}")


def _need(holds: bool, says: str) -> None:
    if not holds:
        raise ConfigurationError(says)


def matches(path: Column, globs: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (path.rlike(policy_glob(g)) for g in globs), F.lit(False))


def violates(source: Column, target: Column, policy: Policy) -> Column:
    return matches(source, policy.sources) & (matches(target, policy.disallow) if policy.disallow is not None else ~matches(target, policy.allow or ()))


def violations(resolved: DataFrame, policies: Policies) -> DataFrame:
    """resolved: file, line, source_path, target_path and more. Those rows with policy (its id), once for each policy they violate."""
    hit = [F.when(violates(F.col("source_path"), F.col("target_path"), p), F.lit(p.id)) for p in policies.policies]
    broken = F.filter(F.array(*hit) if hit else F.array().cast("array<string>"), lambda x: x.isNotNull())
    return resolved.where(F.col("target_path").isNotNull()).withColumn("policy", F.explode(broken))


def resolved_imports(imports: DataFrame, exports: DataFrame, modules: DataFrame, files: DataFrame) -> DataFrame:
    """The static imports and re-exports whose target is a module, with file, line, source_path and target_path."""
    statements = with_re_exports(imports.where("NOT is_dynamic"), exports)
    done = resolve(statements, modules).where(F.col("target_id").isNotNull())
    names = files.select(F.col("id").alias("file_id"), F.col("path").alias("file"))
    return done.join(names, "file_id", "left").withColumn("file", F.coalesce("file", "source_path"))


def policy_table(spark, policies: Policies) -> DataFrame:
    rows = [(p.id, p.description, p.origin, p.severity, p.recommendation, "allow" if p.disallow is None else "disallow") for p in policies.policies]
    return spark.createDataFrame(rows, "policy string, description string, origin string, severity string, recommendation string, mode string")


def evaluations(broken: DataFrame, policies: Policies) -> DataFrame:
    """id, description, origin, severity, status, violation_count, files (sorted): a row for every policy, kept or not."""
    sums = broken.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("file")).alias("files"))
    all_ = policy_table(broken.sparkSession, policies).join(sums, "policy", "left")
    return all_.select(F.col("policy").alias("id"), "description", "origin", "severity", F.when(F.col("n") > 0, "failed").otherwise("passed").alias("status"), F.coalesce("n", F.lit(0)).alias("violation_count"), F.coalesce("files", F.array().cast("array<string>")).alias("files")).orderBy("id")


def findings(broken: DataFrame, policies: Policies) -> DataFrame:
    """The violations as findings; they are not made distinct here."""
    told = broken.join(F.broadcast(policy_table(broken.sparkSession, policies)), "policy")
    proof = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(c).alias("value")) for m, c in (("source", "source_path"), ("target", "target_path"), ("policyMode", "mode"))))
    return told.select(
        F.lit(POLICY_RULE).alias("rule_id"), F.lit("architecture").alias("category"), "severity", F.concat(F.lit("Policy violation: "), "policy").alias("title"),
        F.concat("source_path", F.lit(" imports "), "target_path", F.lit(", which violates policy "), "policy", F.lit(".")).alias("description"), F.col("description").alias("rationale"), "recommendation",
        "file", F.col("line").cast("int").alias("line"), F.lit(1).alias("column"), proof.alias("evidence"),
        metadata(policyDescription=F.col("description"), policyId=F.col("policy"), targetPath=F.col("target_path")).alias("metadata"), key(POLICY_RULE, F.col("policy"), F.col("file"), F.col("line"), F.col("target_path")).alias("id"),
    )
