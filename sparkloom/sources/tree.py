"""A directory tree as a Spark data source, and walks that follow links.

`spark.read.format("project_tree").load(root)` lists the entries below a root that all executors see: directories, files, links
(where they lead, if to a directory) and hidden directories. The driver looks into WIDE directories at most, to deal out the tree;
each partition is a directory, with all below it or with its own files alone. Directories that are passed by are never entered.

With `contents` a file's bytes come along, for those files only that pass the pushed filters: comparisons with path, name,
extension, size, kind and the marks of tests, stories and generated files. The others are never opened.

Links are never entered by the source. `follow` adds what they lead to: the directories that links found so far lead to and that
weren't entered yet are walked by tasks, which finds further links, until none is new. A directory counts by its real path, so loops end.

Unreadable directories and broken links are passed by. An empty tree gives the root's row alone.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

from ..functions.session import bounded, shipped, stored

NAME = "project_tree"
SCHEMA = "path string, below string, name string, extension string, kind string, target string, size long, last_modified timestamp, is_test boolean, is_story boolean, is_generated boolean, content binary"
#: Directories that the driver looks into at most; rows and bytes of contents that are given out together.
WIDE, ROWS, BYTES = 64, 256, 16 << 20
TEST_FILE, STORY_FILE, GENERATED_FILE = r"\.(test|spec)\.[^.]+$", r"\.stories\.[^.]+$", r"\.(generated|gen)\."
_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64(), "timestamp": pa.timestamp("us", tz="UTC"), "boolean": pa.bool_(), "binary": pa.binary()}
_ARROW = pa.schema([pa.field(*(n, _TYPES[t])) for n, t in (x.split() for x in SCHEMA.split(", "))])
_COMPARED: dict[type, Callable] = {
    EqualTo: lambda v, x: v == x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x,
    In: lambda v, x: v in x, StringContains: lambda v, x: x in v, StringEndsWith: lambda v, x: v.endswith(x), StringStartsWith: lambda v, x: v.startswith(x),
}


class Walk:
    """What is below a directory, without what is passed by."""

    def __init__(self, root: str, passed_by: Iterable[str], ignored: Iterable[str], hidden: bool):
        self.root, self.passed_by, self.hidden = root, frozenset(passed_by), hidden
        self.ignored = re.compile("|".join(f"(?:{x})" for x in ignored)) if ignored else None

    def _row(self, entry: os.DirEntry, below: str, kind: str) -> dict:
        found = entry.stat(follow_symlinks=False)
        stem, dot, end = entry.name.rpartition(".")
        name = entry.name
        return dict.fromkeys(_COLUMNS) | {
            "path": os.path.relpath(entry.path, self.root).replace(os.sep, "/"), "below": f"{below}/{name}".removeprefix("/"), "name": name, "extension": (dot + end).lower() if stem else "", "kind": kind,
            "size": found.st_size, "last_modified": datetime.fromtimestamp(found.st_mtime, UTC), "is_test": bool(re.search(TEST_FILE, name)), "is_story": bool(re.search(STORY_FILE, name)), "is_generated": bool(re.search(GENERATED_FILE, name)),
        }

    def here(self, directory: str, below: str) -> tuple[list[dict], list[tuple[str, str]]]:
        """(rows, directories to enter as (path, path below where the walk began)) of one directory."""
        rows, inner = [], []
        try:
            entries = sorted(os.scandir(directory), key=lambda e: e.name)
        except OSError:
            return rows, inner
        real = os.path.realpath(directory)
        rows.append(dict.fromkeys(_COLUMNS) | {"path": os.path.relpath(directory, self.root).replace(os.sep, "/"), "below": below, "name": os.path.basename(directory), "kind": "directory", "target": real})
        for e in entries:
            try:
                if e.name.startswith(".") and not self.hidden and not e.is_file(follow_symlinks=False):
                    rows.append(self._row(e, below, "hidden"))
                elif e.is_symlink():
                    to = os.path.realpath(e.path)
                    rows.append(self._row(e, below, "link") | {"target": to if os.path.isdir(to) else None})
                elif e.is_dir(follow_symlinks=False):
                    path = os.path.relpath(e.path, self.root).replace(os.sep, "/")
                    if e.name not in self.passed_by and not (self.ignored and self.ignored.search(path)):
                        inner.append((e.path, f"{below}/{e.name}".removeprefix("/")))
                elif e.is_file(follow_symlinks=False):
                    rows.append(self._row(e, below, "file"))
            except OSError:
                continue
        return rows, inner

    def all(self, directory: str, below: str = "") -> Iterator[dict]:
        todo = [(directory, below)]
        while todo:
            rows, inner = self.here(*todo.pop())
            todo += reversed(inner)
            yield from rows


class _Part(InputPartition):
    def __init__(self, directory: str, below: str, deep: bool):
        self.directory, self.below, self.deep = directory, below, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].removeprefix("file://")
        self.walk = Walk(self.root, json.loads(options.get("passed_by", "[]")), json.loads(options.get("ignored", "[]")), options.get("hidden", "false") == "true")
        self.contents = options.get("contents", "false") == "true"
        self.filters: list[tuple[str, Callable[[object], bool]]] = []

    def _pushed(self, f: Filter) -> tuple[str, Callable[[object], bool]] | None:
        inner = f.child if isinstance(f, Not) else f
        name = inner.attribute[0] if len(inner.attribute) == 1 else None
        if name not in _COLUMNS or name == "content":
            return None
        if isinstance(f, IsNotNull):
            return name, lambda v: v is not None
        test = _COMPARED.get(type(inner))
        if test is None or isinstance(inner.value, datetime):
            return None
        wanted = not isinstance(f, Not)
        return name, lambda v: v is not None and test(v, inner.value) is wanted

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            told = self._pushed(f) if type(f) in (*_COMPARED, Not, IsNotNull) else None
            if told is None:
                yield f
            else:
                self.filters.append(told)

    def partitions(self) -> list[InputPartition]:
        todo, out = deque([(self.root, "")]), []
        for _ in range(WIDE):
            if not todo:
                break
            directory, below = todo.popleft()
            out.append(_Part(directory, below, False))
            todo += self.walk.here(directory, below)[1]
        return out + [_Part(d, b, True) for d, b in todo]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        rows = self.walk.all(part.directory, part.below) if part.deep else self.walk.here(part.directory, part.below)[0]
        held, size = [], 0
        for row in rows:
            if all(test(row[name]) for name, test in self.filters):
                if self.contents and row["kind"] == "file":
                    try:
                        row["content"] = open_file(os.path.join(self.root, row["path"]))
                    except OSError:
                        continue
                    size += row["size"]
                held.append(row)
                if len(held) >= ROWS or size >= BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


def open_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> TreeReader:
        return TreeReader(dict(self.options))


def tree(spark: SparkSession, root: str, passed_by: Iterable[str] = (), ignored: Iterable[str] = (), hidden: bool = False, contents: bool = False) -> DataFrame:
    """The entries below root (see SCHEMA). passed_by: names of directories, ignored: patterns of paths, that aren't entered."""
    shipped(spark)
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = spark.read.format(NAME).option("passed_by", json.dumps([*passed_by])).option("ignored", json.dumps([*ignored]))
    return read.option("hidden", str(hidden).lower()).option("contents", str(contents).lower()).load(root)


def follow(found: DataFrame, root: str, passed_by: Iterable[str] = (), ignored: Iterable[str] = (), hidden: bool = False) -> DataFrame:
    """found (of tree) and what its links lead to, over any number of links; every directory once. Paths are relative to root, so that they may begin with `..`.

    A round walks the directories that links lead to and that none of the rounds before entered, each to its end but for links.
    """
    spark, patterns, names = found.sparkSession, [*ignored], [*passed_by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(root, names, patterns, hidden)
        for batch in batches:
            for at in batch.column("target").to_pylist():
                held = []
                for row in walk.all(at):
                    held.append(row)
                    if len(held) >= ROWS:
                        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=_ARROW)

    parent = F.regexp_replace("path", "(^|/)[^/]*$", "")
    done = stored(found, "tree")
    entered = done.where("kind = 'directory'").select("target")
    fresh = done
    while True:
        leads = fresh.where("kind = 'link' AND target IS NOT NULL").select("target").distinct()
        frontier = stored(leads.join(bounded(stored(entered, "entered")), "target", "left_anti"), "links")
        if frontier.isEmpty():
            return done
        # one directory to a task at most, as trees can be large
        rows = stored(frontier.repartition(max(1, min(frontier.count(), 10_000)), "target").mapInArrow(run, SCHEMA), "tree")
        # targets within one another, or around what was entered, give directories twice: the one with the shortest way counts
        own = F.when(F.col("kind") == "directory", F.col("path")).otherwise(parent)
        first = rows.groupBy("path").agg(F.min(F.struct(F.length("below"), "below", *(c for c in _COLUMNS if c not in ("path", "below", "content")))).alias("x"))
        once = first.select("path", "x.*").withColumn("content", F.lit(None).cast("binary")).select(*_COLUMNS).withColumn("_own", own)
        known = done.where("kind = 'directory'").select(F.when(F.col("path") == ".", "").otherwise(F.col("path")).alias("_own"))
        fresh = stored(once.join(bounded(stored(known, "known")), "_own", "left_anti").drop("_own"), "tree")
        done = done.unionByName(fresh)
        entered = done.where("kind = 'directory'").select("target")
