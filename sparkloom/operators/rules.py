"""The rule catalogue and the rule engine.

A rule takes the context (named DataFrames and the configuration) and returns findings: rule_id, category, severity, title,
description, rationale, recommendation, file, line, column, evidence (array of metric and value as strings), metadata (a variant) and
id. All are filters, anti-joins and grouped counts; thresholds are parameters and must be exceeded.

`execute` makes one plan of all rules. `execute_apart` runs each in a job of its own, some at once, each with a time limit: a rule
that fails while it runs, or doesn't end, is reported, and what the others find stays.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import basename, dirname, key, parent_steps, route_depth
from ..functions.metadata import metadata
from ..functions.session import stored
from .score import severity_rank

# Files whose exports a framework uses, and tools' configuration files.
CONVENTION_FILE = r"(?:^|/)app(?:/.*)?/(?:default|error|forbidden|global-error|icon|layout|loading|manifest|not-found|opengraph-image|page|robots|route|sitemap|template|twitter-image|unauthorized)\.[^.]+$"
TOOL_FILE = r"^(?:postcss|tailwind|next|vite|webpack|eslint|prettier|babel|jest|vitest|tsup|playwright|cypress|stylelint|commitlint|lint-staged|release|turbo)\.config(?:\.[^.]+)?$"


@dataclass(frozen=True)
class Context:
    """tables: files, modules, imports, exports, components, routes, nodes, edges, degrees, orphans, cycles, depth (those a rule needs)."""

    tables: dict[str, DataFrame]
    root: str = "."
    framework: str = "unknown"
    thresholds: dict[str, dict[str, float]] = field(default_factory=dict)
    #: By rule: a severity, or off.
    severities: dict[str, str] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def threshold(self, rule: str, name: str, usual: float) -> float:
        said = self.thresholds.get(rule, {}).get(name)
        return said if isinstance(said, (int, float)) and not isinstance(said, bool) else usual


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    severity: str
    run: Callable[[Context], DataFrame]
    supports: Callable[[Context], bool] = lambda _: True


def evidence(**values: Column | float | str) -> Column:
    items = [F.struct(F.lit(k).alias("metric"), (v if isinstance(v, Column) else F.lit(v)).cast("string").alias("value")) for k, v in values.items()]
    return F.array(*items) if items else F.array().cast("array<struct<metric:string,value:string>>")


# The rules' descriptions below, which are part of a finding's key.


def finding_key(rule: Column, file: Column, line: Column, description: Column) -> Column:
    return key(rule, file, line, description)


def found(rows: DataFrame, ctx: Context, title: str | Column, description: Column, rationale: str | Column, recommendation: str | Column, proof: Column, file_id: Column | None = None, line: Column | None = None) -> DataFrame:
    """rows as findings, without what the engine adds. A file that isn't known, or none, is the project's root."""
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    told = rows.select((file_id if file_id is not None else F.lit(None)).cast("string").alias("_id"), (line if line is not None else F.lit(1)).cast("int").alias("line"), text(title).alias("title"), description.alias("description"), text(rationale).alias("rationale"), text(recommendation).alias("recommendation"), proof.alias("evidence"))
    files = ctx["files"].select(F.col("id").alias("_id"), F.col("path").alias("file"))
    return told.join(files, "_id", "left").withColumn("file", F.coalesce("file", F.lit(ctx.root))).withColumn("column", F.lit(1)).drop("_id")


def _over(table: str, rule: str, name: str, usual: float, value: Callable[[], Column], title: str, says: Callable[[Column], Column], why: str, do: str, metric: str, line: str | None = None) -> Callable[[Context], DataFrame]:
    """A rule that holds a measure of each row against a threshold."""

    def run(ctx: Context) -> DataFrame:
        most = ctx.threshold(rule, name, usual)
        rows = ctx[table].withColumn("_v", value()).where(F.col("_v") > most)
        return found(rows, ctx, title, says(F.col("_v")), why, do, evidence(**{metric: F.col("_v"), "threshold": most}), F.col("file_id"), F.col(line) if line else None)

    return run


def _say(*parts: Column | str) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def circular_imports(ctx: Context) -> DataFrame:
    nodes = ctx["nodes"].select(F.col("id").alias("node"), "path")
    modules = ctx["modules"].select(F.col("id").alias("node"), "file_id")
    spots = ctx["cycles"].select(F.col("id").alias("cycle"), "length", F.posexplode("nodes").alias("at", "node")).join(nodes, "node").join(modules, "node", "left")
    ring = spots.groupBy("cycle", "length").agg(F.array_sort(F.collect_list(F.struct("at", "path", "file_id"))).alias("r"))
    paths = F.transform("r", lambda x: x["path"])
    closed = F.array_join(F.concat(paths, F.slice(paths, 1, 1)), " → ")
    return found(ring, ctx, "Modules import each other in a circle", _say("Circular dependency: ", closed, "."), "Initialization order inside a cycle is hard to predict, and so is a change.", "Move what both sides share into a module of its own.", evidence(cycleLength=F.col("length"), cyclePaths=closed), F.get("r", F.lit(0))["file_id"])


def deep_chain(ctx: Context) -> DataFrame:
    most = ctx.threshold("deep-dependency-chain", "maxDepth", 10)
    rows = ctx["depth"].where(F.col("max_depth") > most)
    return found(rows, ctx, "A long chain of dependencies", _say("The maximum dependency depth is ", F.col("max_depth"), "."), "Each layer of a long chain depends on all those below it.", "Flatten the layers, or draw a boundary between them.", evidence(maxDepth=F.col("max_depth"), threshold=most))


def duplicate_imports(ctx: Context) -> DataFrame:
    rows = ctx["imports"].groupBy("file_id", "source").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return found(rows, ctx, "One source, several imports", _say("The module imports ", F.col("source"), " ", F.col("n"), " times."), "Several imports of one source hide what a module depends on.", "Merge them into one declaration.", evidence(importCount=F.col("n")), F.col("file_id"))


def barrel_overuse(ctx: Context) -> DataFrame:
    most = ctx.threshold("barrel-file-overuse", "maxExports", 30)
    rows = ctx["modules"].where(basename(F.col("path")).startswith("index.") & (F.col("n_exports") > most))
    return found(rows, ctx, "An index file that exports too much", _say(F.col("path"), " exports ", F.col("n_exports"), " symbols."), "A large barrel hides who owns what.", "Split the exports by domain.", evidence(exports=F.col("n_exports"), threshold=most), F.col("file_id"))


def unused_exports(ctx: Context) -> DataFrame:
    """By name over all modules: an export is used if any import binds its name."""
    used = ctx["imports"].select(F.explode("specifiers").alias("name")).distinct()
    rows = ctx["exports"].where(~F.col("is_default") & ~F.col("name").isin("default", "*")).join(used, "name", "left_anti")
    if ctx.framework == "next":
        kept = ctx["files"].where(F.col("path").rlike(CONVENTION_FILE)).select(F.col("id").alias("file_id"))
        rows = rows.join(kept, "file_id", "left_anti")
    return found(rows, ctx, "Nothing here imports this export", _say(F.col("name"), " is not imported by another scanned module."), "An export that nothing uses still has to be kept up.", "Remove it, or say who uses it.", evidence(export=F.col("name")), F.col("file_id"), F.col("line"))


def anonymous_exports(ctx: Context) -> DataFrame:
    rows = ctx["exports"].where("is_default AND is_anonymous")
    return found(rows, ctx, "A default export without a name", F.lit("A default export has no stable symbol name."), "Names make stack traces and searches readable.", "Give the exported function or component a name.", evidence(), F.col("file_id"), F.col("line"))


def module_load(modules: DataFrame, degrees: DataFrame) -> DataFrame:
    """modules with load: imports, exports, a 25th of the lines, and edges either way."""
    both = modules.join(degrees, "id", "left")
    return both.withColumn("load", F.col("n_imports") + F.col("n_exports") + F.col("line_count") / 25 + F.coalesce("fan_in", F.lit(0)) + F.coalesce("fan_out", F.lit(0)))


def god_modules(ctx: Context) -> DataFrame:
    most = ctx.threshold("god-module", "maxScore", 50)
    rows = module_load(ctx["modules"], ctx["degrees"]).where(F.col("load") > most)
    number = F.regexp_replace(F.col("load").cast("string"), r"\.0$", "")
    return found(rows, ctx, "A module that does too much", _say(F.col("path"), " has combined complexity score ", number, "."), "What is large and connected is in the way of every change.", "Split it by responsibility.", evidence(combinedScore=number, threshold=most), F.col("file_id"))


def orphan_modules(ctx: Context) -> DataFrame:
    rows = ctx["orphans"].where("type = 'module'").where(~basename(F.col("path")).rlike(TOOL_FILE)).join(ctx["modules"].select("id", "file_id"), "id", "left")
    return found(rows, ctx, "A module on its own", _say(F.col("path"), " has no incoming or outgoing dependencies."), "A module that nothing meets may be dead.", "Delete it, or use it where it belongs.", evidence(), F.col("file_id"))


def _fan(rule: str, side: str, usual: int, label: str, do: str) -> Callable[[Context], DataFrame]:
    def run(ctx: Context) -> DataFrame:
        most = ctx.threshold(rule, "maxDependencies", usual)
        rows = ctx["degrees"].where(F.col(side) > most).join(ctx["modules"].select("id", "file_id", "path"), "id")
        return found(rows, ctx, f"Too much {side.replace('_', '-')}", _say(F.col("path"), " has ", F.col(side), f" {label}."), "Much coupling spreads every change.", do, evidence(dependencies=F.col(side), threshold=most), F.col("file_id"))

    return run


def excessive_files(ctx: Context) -> DataFrame:
    most = ctx.threshold("excessive-file-count", "maxFiles", 100)
    rows = ctx["files"].groupBy(dirname(F.col("path")).alias("folder")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return found(rows, ctx, "A crowded folder", _say(F.col("folder"), " contains ", F.col("n"), " files."), "Nobody owns a folder that holds everything.", "Split it by feature.", evidence(files=F.col("n"), threshold=most))


def _component(rule: str, name: str, usual: int, value: Callable[[], Column], title: str, verb: str, unit: str, why: str, do: str, metric: str) -> Rule:
    said = lambda v: _say(F.col("name"), f" {verb} ", v, f"{unit}.")
    return Rule(rule, "hooks" if rule == "too-many-hooks" else "components", "warning", _over("components", rule, name, usual, value, title, said, why, do, metric))


def _module(rule: str, category: str, name: str, usual: int, column: str, title: str, unit: str, do: str, metric: str) -> Rule:
    said = lambda v: _say(F.col("path"), " has ", v, f" {unit}.")
    return Rule(rule, category, "warning", _over("modules", rule, name, usual, lambda: F.col(column), title, said, "The larger a module, the more there is to keep up.", do, metric))


RULES: tuple[Rule, ...] = (
    Rule("no-circular-imports", "imports", "critical", circular_imports),
    Rule("deep-dependency-chain", "imports", "warning", deep_chain),
    Rule("duplicate-imports", "imports", "warning", duplicate_imports),
    Rule("barrel-file-overuse", "imports", "warning", barrel_overuse),
    Rule("unused-export", "imports", "info", unused_exports),
    _component("large-component", "maxLines", 300, lambda: F.col("line_count"), "A component of too many lines", "has", " logical lines", "A large component does too much.", "Split it into smaller components or hooks.", "linesOfCode"),
    _component("excessive-props", "maxProps", 10, lambda: F.size("props"), "A component with a wide interface", "declares", " props", "A wide interface is hard to understand.", "Group the props, or compose.", "props"),
    _component("deeply-nested-jsx", "maxDepth", 8, lambda: F.col("jsx_depth"), "Markup nested too deeply", "has JSX depth", "", "Deep trees are hard to read and test.", "Take inner components out.", "jsxDepth"),
    _component("too-many-hooks", "maxHooks", 15, lambda: F.size("hooks"), "A component with many hooks", "uses", " distinct hooks", "Many hooks mean mixed duties.", "Move what belongs together into hooks of its own.", "hooks"),
    Rule("anonymous-default-export", "components", "warning", anonymous_exports),
    Rule("god-module", "architecture", "warning", god_modules),
    Rule("orphan-module", "architecture", "warning", orphan_modules),
    Rule("high-fan-out", "architecture", "warning", _fan("high-fan-out", "fan_out", 20, "outgoing dependencies", "Depend on less, or split it.")),
    Rule("high-fan-in", "architecture", "warning", _fan("high-fan-in", "fan_in", 30, "incoming dependencies", "Give it a stable interface, or split it.")),
    Rule("deeply-nested-routes", "routes", "warning", _over("routes", "deeply-nested-routes", "maxDepth", 8, lambda: route_depth(F.col("path")), "A route of too many levels", lambda v: _say(F.col("path"), " has ", v, " route levels."), "Deep routes are hard to find one's way in.", "Make the routes flatter.", "routeDepth", "line")),
    _module("oversized-module", "complexity", "maxLines", 500, "line_count", "A module of too many lines", "logical lines", "Split it by responsibility.", "lineCount"),
    _module("heavy-import-hub", "performance", "maxImports", 50, "n_imports", "A module that imports too much", "imports", "Depend on less at once.", "imports"),
    _module("excessive-export-count", "complexity", "maxExports", 40, "n_exports", "A module that exports too much", "exports", "Split the public interface.", "exports"),
    Rule("long-relative-import", "imports", "warning", _over("imports", "long-relative-import", "maxParentTraversals", 4, lambda: parent_steps(F.col("source")), "A relative import from far away", lambda v: _say(F.col("source"), " traverses ", v, " parent directories."), "Long relative paths break when files move.", "Use an alias, or move what is shared closer.", "parentTraversals", "line")),
    Rule("excessive-file-count", "architecture", "warning", excessive_files),
)


class DuplicateRule(ValueError):
    """A rule of that id is registered already."""


class Registry:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self._rules: dict[str, Rule] = {}
        for r in rules:
            self.register(r)

    def register(self, rule: Rule) -> None:
        if rule.id in self._rules:
            raise DuplicateRule(rule.id)
        self._rules[rule.id] = rule

    def rules(self) -> list[Rule]:
        return [self._rules[k] for k in sorted(self._rules)]


def scheduled(registry: Registry, ctx: Context) -> list[tuple[Rule, str]]:
    """The rules to run with their severities, by id: not those that are off or that don't support the context (or fail to say)."""
    out = []
    for r in registry.rules():
        try:
            fits = r.supports(ctx)
        except Exception:  # noqa: BLE001  a rule of others that can't tell is left out
            fits = False
        said = ctx.severities.get(r.id, r.severity)
        if fits and said != "off":
            out.append((r, said))
    return out


def collect(findings: DataFrame) -> DataFrame:
    """The valid findings in order, the first by id of those that agree in rule, file, line and description."""
    by = ["rule_id", "file", "line", "description"]
    rest = [c for c in findings.columns if c not in by]
    first = findings.where("file <> '' AND line > 0").groupBy(*by).agg(F.min_by(F.struct(*rest), "id").alias("_first"))  # combined before the shuffle
    return first.select(*(F.col(c if c in by else f"_first.{c}").alias(c) for c in findings.columns))


def planned(rule: Rule, severity: str, ctx: Context) -> DataFrame:
    """What a rule finds, in the columns that all rules have."""
    rows = rule.run(ctx)
    told = F.col("metadata") if "metadata" in rows.columns else metadata()
    return rows.select(F.lit(rule.id).alias("rule_id"), F.lit(rule.category).alias("category"), F.lit(severity).alias("severity"), "title", "description", "rationale", "recommendation", "file", "line", "column", "evidence", told.alias("metadata"))


def _united(parts: list[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("no rule ran")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return collect(out.withColumn("id", finding_key(F.col("rule_id"), F.col("file"), F.col("line"), F.col("description"))))


def execute(ctx: Context, registry: Registry | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The findings of all rules as one plan, and by rule what went wrong with those whose plan can't be built.

    A rule that fails later, when the plan runs, fails the action; see execute_apart.
    """
    parts, failed = [], {}
    for rule, severity in scheduled(registry or Registry(), ctx):
        try:
            parts.append(planned(rule, severity, ctx))
        except Exception as e:  # noqa: BLE001  one rule's failure isn't the others'
            failed[rule.id] = str(e)
    return _united(parts), failed


@dataclass(frozen=True)
class Outcome:
    """How a rule ended: completed, failed, timed-out or aborted; and why, if it didn't complete."""

    rule: str
    status: str
    seconds: float
    why: str = ""


class Aborted(RuntimeError):
    """The caller asked to stop."""


def execute_apart(ctx: Context, registry: Registry | None = None, seconds: float = 600.0, at_once: int = 4, abort: threading.Event | None = None, tags: tuple[str, ...] = ()) -> tuple[DataFrame, list[Outcome]]:
    """The findings of the rules that completed, and every rule's outcome, by id.

    Each rule's findings are stored by a job of its own, at_once of them side by side; the jobs carry a tag, by which those of a rule that
    takes over `seconds` (from its own start, and again when it runs alone), or all when `abort` is set, are cancelled. A rule that doesn't
    end outside its jobs keeps its thread, but nobody waits for it. tags: further tags of the jobs.
    """
    todo = scheduled(registry or Registry(), ctx)
    spark = next(iter(ctx.tables.values())).sparkSession
    context, abort = spark.sparkContext, abort or threading.Event()
    free = threading.Semaphore(max(1, at_once))

    def run(rule: Rule, severity: str) -> tuple[DataFrame | None, Outcome]:
        tag, done, got = f"rule-{uuid.uuid4().hex}", threading.Event(), []
        with free:
            if abort.is_set():
                return None, Outcome(rule.id, "aborted", 0.0)
            began = time.perf_counter()

            def work() -> None:
                try:
                    for t in (tag, *tags):
                        context.addJobTag(t)
                    context.setInterruptOnCancel(True)
                    got.append(stored(planned(rule, severity, ctx), "rule"))
                except BaseException as e:  # noqa: BLE001  one rule's failure isn't the others'
                    got.append(e)
                finally:
                    done.set()

            threading.Thread(target=work, daemon=True).start()
            while not done.wait(0.05) and not abort.is_set() and time.perf_counter() - began <= seconds:
                pass
            took = time.perf_counter() - began
            if not done.is_set():
                context.cancelJobsWithTag(tag)
                return None, Outcome(rule.id, "aborted" if abort.is_set() else "timed-out", took, f"stopped after {took:.1f} seconds")
        if isinstance(got[0], BaseException):
            return None, Outcome(rule.id, "aborted" if abort.is_set() else "failed", took, str(got[0]))
        return got[0], Outcome(rule.id, "completed", took)

    with ThreadPoolExecutor(max(1, len(todo))) as pool:
        ended = [*pool.map(lambda x: run(*x), todo)]
    if at_once > 1:  # a rule that took all cores may have kept others from running: what took too long runs again by itself
        ended = [run(*x) if e[1].status == "timed-out" and not abort.is_set() else e for x, e in zip(todo, ended, strict=True)]
    if abort.is_set():
        raise Aborted("the rules were aborted")
    return _united([df for df, _ in ended if df is not None]), [o for _, o in ended]


def finding_order() -> list[Column | str]:
    return [severity_rank(F.col("severity")), "rule_id", "file", "line", "column", "id"]


def in_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*finding_order())
