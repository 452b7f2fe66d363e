"""The whole analysis of a project: scan, extract, graph, rules, policies, score, report."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metadata import cleaned
from ..functions.order import in_ranges
from ..functions.session import stored
from ..operators import extract, graph, invariants, policies, report, resolve, rules, search
from ..operators import score as scoring
from ..sources import artifacts, project


class AnalysisError(RuntimeError):
    """A stage failed; the cause is attached."""


#: By what the tables that are written whole are ordered; findings as rules.finding_order says.
ORDERS = {
    "files": ("path",), "modules": ("path",), "imports": ("file_id", "line", "source"), "exports": ("file_id", "line", "name"), "components": ("file_id", "position", "name"), "hooks": ("file_id", "position"), "contexts": ("file_id", "position"),
    "routes": ("file_id", "line", "column", "path"), "symbols": ("file_id", "position", "name"), "nodes": ("id",), "edges": ("id",), "cycles": ("id",), "errors": ("file_id", "line", "column", "message"), "deductions": ("rule_id", "category"), "policies": ("id",), "risks": ("title",),
}


@dataclass(frozen=True)
class Analysis:
    project: project.Project
    tables: dict[str, DataFrame]
    findings: DataFrame
    evaluations: DataFrame
    score: scoring.Score
    failed_rules: dict[str, str]
    outcomes: list[rules.Outcome]
    timings: dict[str, float]

    def published(self) -> DataFrame:
        """The findings as they are published: files below the root, evidence in the artifact's shape and order."""
        columns = ("id", "rule_id", "category", "severity", "title", "description", "rationale", "recommendation", "file", "line", "column", "evidence", "metadata")
        told = self.findings.select(*columns).withColumn("file", report.relative_path(F.col("file"), self.project.root)).withColumn("evidence", report.evidence_view(F.col("evidence")))
        return told.withColumn("metadata", cleaned(F.col("metadata")))

    def published_nodes(self) -> DataFrame:
        """The nodes with cleaned metadata."""
        return self.tables["nodes"].withColumn("metadata", cleaned(F.col("metadata")))

    def write(self, folder: str) -> dict[str, dict]:
        """Writes what the report is cut from, and the model, whole, as JSON lines with Spark: by name, the place in the folder and the number of rows.

        Each table is in its order (ORDERS), over its files in the order of their names.
        """
        whole = {name: self.tables[name] for name in ORDERS if name in self.tables} | {"findings": self.published(), "nodes": self.published_nodes(), "deductions": self.score.deductions, "policies": self.evaluations}
        whole["risks"] = report.risks(self.findings)
        out = {}
        for name, df in whole.items():
            in_ranges(df, *(rules.finding_order() if name == "findings" else ORDERS[name])).write.json(f"{folder}/{name}")
            out[name] = {"place": f"{folder.rsplit('/', 1)[-1]}/{name}", "rows": df.count()}
        return out

    def artifact(self, generated_at: str | None = None, history: DataFrame | None = None, benchmark: dict | None = None, most: int = 1000, whole: dict | None = None) -> dict:
        """The bounded report; tables of any size stay in `tables`. whole: where write() put them."""
        row = self.score.total.first().asDict()
        nodes = self.tables["nodes"].count()
        cycles = self.tables["cycles"].count()
        spots = report.hotspots(self.findings, self.score.deductions, self.score.categories)
        wins = stored(report.quick_wins(spots, self.findings), "wins")
        said = scoring.explanation(self.score.categories, self.score.total, nodes, cycles).first().asDict()
        now = generated_at or datetime.now(UTC).isoformat()
        spark = self.findings.sparkSession
        point = spark.createDataFrame([(now, row["overall"])], "generated_at string, overall double")
        counts = scoring.severity_counts(self.findings).first().asDict()
        pick = lambda df, n: artifacts.rows(df, n)
        return artifacts.checked(
            {
                "metadata": {"schema": artifacts.SCHEMA_ID, "version": artifacts.VERSION, "generated_at": now, "timings": self.timings} | ({"tables": whole} if whole else {}),
                "project": {"name": self.project.name, "framework": self.project.framework, "package_manager": self.project.package_manager, "workspace": self.project.workspace, "root": "."},
                "summary": {"overall": row["overall"], "grade": row["grade"], **counts},
                "metrics": report.metrics(self.tables["modules"], self.tables["nodes"]).first().asDict(),
                "score": {"categories": pick(self.score.categories.orderBy("category"), 100), "deductions": pick(self.score.deductions.orderBy("rule_id"), most), "contributors": pick(self.score.contributors.orderBy(F.desc("impact"), "label"), 100)},
                "findings": pick(rules.in_order(self.published()), most),
                "graph": {"statistics": self.tables["statistics"].first().asDict(), "nodes": pick(self.published_nodes().orderBy("id"), most), "edges": pick(self.tables["edges"].orderBy("id"), most)},
                "analysis": {
                    **said, "hotspots": pick(report.top_hotspots(spots), 8), "quick_wins": pick(wins, report.QUICK_WINS), "roadmap": pick(report.roadmap(spots, wins), report.ROADMAP), "risks": pick(report.risks(self.findings), most),
                    "history": pick(report.timeline(point if history is None else history.unionByName(point)), report.HISTORY), "benchmark": pick(report.benchmark(self.score.total, benchmark, self.project.framework), 1)[0], "policies": pick(self.evaluations, most), "parser_errors": pick(report.parser_errors(self.tables["errors"]), most),
                },
            }
        )


def analyze(spark: SparkSession, path: str, policy_file: str | None = None, score_config: scoring.ScoreConfig = scoring.ScoreConfig(), thresholds: dict | None = None, severities: dict | None = None, registry: rules.Registry | None = None, follow_links: bool = False, progress: Callable[[str], None] = lambda _: None, rule_seconds: float = 600.0, abort: threading.Event | None = None) -> Analysis:
    """rule_seconds: the time limit of a rule. abort: when it is set, the jobs are cancelled and rules.Aborted is raised."""
    abort = abort or threading.Event()
    with _cancelled_by(spark, abort) as tag:
        try:
            return _analyze(spark, path, policy_file, score_config, thresholds, severities, registry, follow_links, progress, rule_seconds, abort, tag)
        except Exception as e:
            if abort.is_set() and not isinstance(e, rules.Aborted):
                raise rules.Aborted("the analysis was aborted") from e
            raise


@contextmanager
def _cancelled_by(spark: SparkSession, abort: threading.Event):
    """Gives this thread's jobs a tag and cancels them when abort is set."""
    context, tag, over = spark.sparkContext, f"analysis-{uuid.uuid4().hex}", threading.Event()

    def watch() -> None:
        while not over.wait(0.1):
            if abort.is_set():
                context.cancelJobsWithTag(tag)

    context.addJobTag(tag)
    threading.Thread(target=watch, daemon=True).start()
    try:
        yield tag
    finally:
        over.set()
        context.removeJobTag(tag)


def _analyze(spark: SparkSession, path: str, policy_file: str | None, score_config: scoring.ScoreConfig, thresholds: dict | None, severities: dict | None, registry: rules.Registry | None, follow_links: bool, progress: Callable[[str], None], rule_seconds: float, abort: threading.Event, tag: str) -> Analysis:
    timings: dict[str, float] = {}

    def stage(name: str, work: Callable):
        progress(name)
        if abort.is_set():
            raise rules.Aborted(f"aborted before {name}")
        began = time.perf_counter()
        try:
            return work()
        except (project.ScanError, policies.ConfigurationError, rules.Aborted):
            raise
        except Exception as e:
            raise AnalysisError(name) from e
        finally:
            timings[name] = time.perf_counter() - began

    described = stage("describe", lambda: project.describe(path))
    rules_of = stage("policies", lambda: policies.load(policy_file or f"{path}/.loom.json"))
    listing = stage("list", lambda: stored(project.listed(spark, described.root, described.ignore, follow_links), "listing"))
    files = stage("scan", lambda: stored(project.scan(listing, described.ignore), "files"))
    facts = stage("extract", lambda: stored(extract.extract(project.contents(spark, described.root, files)), "facts"))
    t = {"listing": listing, "files": files, "modules": stage("modules", lambda: stored(extract.modules(facts), "modules"))}
    for kind in ("imports", "exports", "components", "hooks", "contexts", "symbols", "errors"):
        t[kind] = extract.kind_of(facts, kind)
    columns = ["file_id", "path", "kind", "line", "column", "id"]
    t["routes"] = extract.kind_of(facts, "routes").select(*columns)
    if described.framework == "next":
        t["routes"] = t["routes"].unionByName(extract.file_routes(files, "next").select(*columns))
    classified = resolve.classify(resolve.resolve(resolve.with_re_exports(t["imports"], t["exports"]), t["modules"]))
    t["edges"] = stage("edges", lambda: stored(graph.upsert_edges(resolve.statements_of(classified)), "edges"))
    t["nodes"] = stored(graph.node_union(resolve.module_nodes(t["modules"]), resolve.target_nodes(classified)), "nodes")
    t["degrees"], t["orphans"] = graph.degrees(t["nodes"], t["edges"]), graph.orphans(t["nodes"], t["edges"])
    found_ways = stage("search", lambda: search.searched(t["edges"].withColumn("project", F.lit(described.id))))
    t["cycles"] = search.cycles(found_ways).drop("project")
    components = stage("components", lambda: graph.weak_components(t["nodes"], t["edges"]))
    t["statistics"] = graph.statistics(t["nodes"], t["edges"], components)
    t["depth"] = search.max_depth(found_ways)
    ctx = rules.Context(t, described.root, described.framework, thresholds or {}, severities or {})
    found, outcomes = stage("rules", lambda: rules.execute_apart(ctx, registry, rule_seconds, abort=abort, tags=(tag,)))
    failed = {o.rule: o.why for o in outcomes if o.status != "completed"}
    broken = policies.violations(policies.resolved_imports(t["imports"], t["exports"], t["modules"], files), rules_of)
    all_ = stage("findings", lambda: stored(found.unionByName(policies.findings(broken, rules_of).select(*found.columns).dropDuplicates(["id"])) if rules_of.policies else found, "findings"))
    config = score_config if rules_of.source == "none" else scoring.ScoreConfig(**{**score_config.__dict__, "policy_penalties": rules_of.penalties})
    result = stage("score", lambda: scoring.score(all_.withColumn("pos", F.xxhash64("id")), config))
    stage("validate", lambda: invariants.checked(t | {"findings": all_}, described.root))
    return Analysis(described, t, all_, policies.evaluations(broken, rules_of), result, failed, outcomes, timings)
