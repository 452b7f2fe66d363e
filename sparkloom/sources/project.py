"""A project on disk (or in any store Spark reads) as relations: files, manifest facts, counters.

The listing is a Spark scan that reads no contents; what is kept is decided by filters on the path. Only the few files at the root
(manifest, lock files, ignore files) are read by the driver. Roots with a scheme other than file are read by Spark's own file source,
which knows no links; all others by the data source of `tree`.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import SOURCE_EXTENSIONS, basename, extension, ignore_glob, key, normalized
from ..functions.session import shipped
from . import tree

# What marks a project, its package manager and workspace, and what a scan passes by.
MARKERS = ("package.json", "pnpm-workspace.yaml", "yarn.lock", "package-lock.json")
MANAGERS = (("pnpm", "pnpm-lock.yaml"), ("npm", "package-lock.json"), ("yarn", "yarn.lock"), ("bun", "bun.lockb"))
WORKSPACES = (("turborepo", "turbo.json"), ("nx", "nx.json"), ("pnpm", "pnpm-workspace.yaml"))
FRAMEWORKS = (("next", "next"), ("react", "react"), ("vite", "vite"), ("@angular/core", "angular"), ("vue", "vue"), ("svelte", "svelte"))
IGNORED_DIRECTORIES = ("node_modules", ".git", ".next", "dist", "build", "coverage", "storybook-static", "out", ".vercel", ".cache")
MOST_BYTES = 10 * 1024 * 1024


class ScanError(ValueError):
    """There is no project to scan, or its manifest can't be read."""


@dataclass(frozen=True)
class Project:
    root: str
    id: str
    name: str
    framework: str
    package_manager: str
    workspace: str
    ignore: tuple[str, ...] = ()
    dependencies: dict[str, str] = field(default_factory=dict)


def find_root(path: str | Path) -> Path:
    """The nearest directory, from the path upward, that has a marker file."""
    at = Path(path).resolve()
    if not at.is_dir():
        raise ScanError(f"not a directory: {path}")
    for d in (at, *at.parents):
        if any((d / m).is_file() for m in MARKERS):
            return d
    raise ScanError(f"no project at or above {path}")


def ignore_patterns(text: str) -> list[str]:
    """An ignore file's lines but blank ones, comments and negations."""
    return [x for x in map(str.strip, text.splitlines()) if x and x[0] not in "#!"]


def describe(path: str | Path, ignore_files: tuple[str, ...] = (".gitignore", ".loomignore")) -> Project:
    import hashlib

    root = find_root(path)
    manifest = root / "package.json"
    try:
        told = json.loads(manifest.read_text(encoding="utf-8")) if manifest.is_file() else {}
    except json.JSONDecodeError as e:
        raise ScanError(f"{manifest}: {e}") from e
    if not isinstance(told, dict):
        raise ScanError(f"{manifest}: not an object")
    needs = {**(told.get("dependencies") or {}), **(told.get("devDependencies") or {})}
    first = lambda pairs, there, other: next((v for k, v in pairs if there(k)), other)
    is_file = lambda x: (root / x).is_file()
    name = root.as_posix()
    return Project(
        name, hashlib.sha256(name.encode()).hexdigest(), told.get("name") or root.name, first(FRAMEWORKS, needs.__contains__, "unknown"),
        first(((f, m) for m, f in MANAGERS), is_file, "unknown"), first(((f, w) for w, f in WORKSPACES), is_file, "single-package"),
        tuple(p for f in ignore_files if is_file(f) for p in ignore_patterns((root / f).read_text(encoding="utf-8"))), needs,
    )


def framework(dependencies: Column) -> Column:
    """The first that applies, from an array of the names depended on."""
    out = F.lit("unknown")
    for package, name in reversed(FRAMEWORKS):
        out = F.when(F.array_contains(dependencies, package), F.lit(name)).otherwise(out)
    return out


def _elsewhere(root: str) -> bool:
    """Whether a root is in a store that only Spark reads."""
    return re.match(r"[a-z][a-z0-9+.-]*://", root) is not None and not root.startswith("file://")


def _below(root: str) -> Column:
    return normalized(F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^" + _quoted(re.sub("^[a-z]+:/+", "/", root).rstrip("/")) + "/", ""))


def listed(spark: SparkSession, root: str, patterns: tuple[str, ...] = (), follow_links: bool = False, include_hidden: bool = False) -> DataFrame:
    """path (below root), below (from where a walk began: the root, or what a link leads to), size, last_modified of all files but those in directories that are passed by.

    follow_links: also what links to directories lead to, once each, by real paths. Links to files are passed by.
    """
    if _elsewhere(root):
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        own = _below(root)
        return rows.select(own.alias("path"), own.alias("below"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))
    rules = {"passed_by": IGNORED_DIRECTORIES, "ignored": [ignore_glob(p) for p in patterns], "hidden": include_hidden}
    rows = tree.tree(spark, root, **rules)
    if follow_links:
        rows = tree.follow(rows, root, **rules)
    return rows.where(F.col("kind").isin("file", "hidden")).select("path", "below", "size", "last_modified")


def _quoted(text: str) -> str:
    return re.sub(r"([|\\{}()\[\]^$+*?.])", r"\\\1", text)


def ignored(path: Column, patterns: tuple[str, ...], below: Column | None = None) -> Column:
    """Whether the path or a directory above it matches a pattern, or lies (from where the walk began) in a directory that is always passed by."""
    parts = F.split(path, "/", -1)
    inner = parts if below is None else F.split(below, "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    hit = F.exists(F.slice(inner, F.lit(1), F.size(inner) - 1), lambda d: d.isin(*IGNORED_DIRECTORIES))
    any_of = "|".join(f"(?:{ignore_glob(p)})" for p in patterns)
    return hit | F.exists(above, lambda a: a.rlike(any_of)) if patterns else hit


def hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/", -1), lambda x: x.startswith(".") & ~x.isin(".", ".."))


def scan(listing: DataFrame, patterns: tuple[str, ...] = (), most_bytes: int = MOST_BYTES, tests: bool = False, stories: bool = False, include_hidden: bool = False) -> DataFrame:
    """The source files of a listing: id, path, extension, size, last_modified, is_test, is_story, is_skipped, skip_reason.

    A file over the size limit stays, marked as skipped.
    """
    name = basename(F.col("path"))
    rows = listing.where(~ignored(F.col("path"), patterns, F.col("below") if "below" in listing.columns else None)).withColumn("extension", F.lower(extension(F.col("path"))))
    rows = rows.where(F.col("extension").isin(*SOURCE_EXTENSIONS) & ~F.col("path").endswith(".d.ts"))
    rows = rows.withColumn("is_test", name.rlike(tree.TEST_FILE)).withColumn("is_story", name.rlike(tree.STORY_FILE))
    if not include_hidden:
        rows = rows.where(~hidden(F.col("path")))
    if not tests:
        rows = rows.where(~F.col("is_test"))
    if not stories:
        rows = rows.where(~F.col("is_story"))
    big = F.col("size") > most_bytes
    return rows.select(key(F.col("path")).alias("id"), "path", "extension", "size", "last_modified", "is_test", "is_story", big.alias("is_skipped"), F.when(big, F.lit("size")).alias("skip_reason"))


def counters(listing: DataFrame, files: DataFrame) -> DataFrame:
    """One row: total_files, hidden_files, skipped_files, source_files, workspace_packages, largest_file."""
    all_ = listing.agg(F.count(F.lit(1)).alias("total_files"), F.count_if(hidden(F.col("path"))).alias("hidden_files"), F.count_if(basename(F.col("path")) == "package.json").alias("workspace_packages"))
    kept = files.agg(F.count(F.lit(1)).alias("source_files"), F.count_if("is_skipped").alias("skipped_files"), F.min(F.struct((-F.col("size")).alias("less"), "path"))["path"].alias("largest_file"))
    return all_.crossJoin(kept)


def contents(spark: SparkSession, root: str, files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """file_id, path, text of the files that aren't skipped, or generated; others aren't opened."""
    kept = files.where(~F.col("is_skipped") & ~basename(F.col("path")).rlike(tree.GENERATED_FILE)).select(F.col("id").alias("file_id"), "path")
    if _elsewhere(root):
        # Spark opens what passes the glob and the length alone
        names = "*{" + ",".join(SOURCE_EXTENSIONS) + "}"
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(root).where(F.col("length") <= most_bytes)
        return rows.select(_below(root).alias("path"), F.col("content").cast("string").alias("text")).join(kept, "path").select("file_id", "path", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, path in zip(*(batch.column(c).to_pylist() for c in ("file_id", "path")), strict=True):
                try:
                    text = tree.open_file(os.path.join(root, path)).decode("utf-8", "replace")
                except OSError:  # gone since it was listed
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (file_id, path, text)], names=["file_id", "path", "text"])

    shipped(spark)
    root = root.removeprefix("file://")
    return kept.repartition(F.xxhash64("path")).mapInArrow(run, "file_id string, path string, text string")
