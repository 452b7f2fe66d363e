"""The ordered depth-first search of import graphs: the cycles it closes, and how deep it finds each node.

Nodes are taken in the order of their ids, a node's targets in the order of the edges' keys; what was searched before is not
entered again. A node's depth is the longest way on that the search finds: one more than that of a target searched before or below it, one for
a target on the way to the node itself, none without targets. So depths on cycles depend on the order, as cycles do.

Graphs of up to SEARCHED edges are searched each in one task. A larger one is taken apart: the search enters a strong component once,
at the node it meets first, and finds there what depends on nothing but that node and the depths beyond. Components are freed in rounds,
each when all that lead to it are done; a node's place in the search is the least of the ways to it (the first node's id, then
the edges' keys; through a component of several nodes, the place of the edge that leaves it among those that do). Back from the ends, the depths follow in the same way. A round touches the freed components and those that wait; a
component of several nodes is searched in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Container, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import key
from ..functions.session import bounded, stored
from .graph import strong_components, turned

#: The most edges of a graph that one task searches whole.
SEARCHED = 200_000
_BREAK = "\x00"


def _walk(firsts: Iterable[str], targets: dict[str, list[tuple[str, str]]], beyond: dict[str, int], out: Container[str] = ()) -> tuple[list[list[str]], dict[str, int], list[tuple[str, str]]]:
    """targets: by node (edge key, target), in order; beyond: depths from targets elsewhere; out: edges that lead elsewhere.

    (cycles, depth by node, the edges that lead elsewhere (key, target) in the order in which they are met)
    """
    depth: dict[str, int] = {}
    rings: dict[tuple[str, ...], list[str]] = {}
    left: list[tuple[str, str]] = []
    for first in firsts:
        if first in depth:
            continue
        path, place, todo, most = [first], {first: 0}, [iter(targets.get(first, ()))], [beyond.get(first, 0)]
        while path:
            said, to = next(todo[-1], (None, None))
            if to is None:
                node, found = path.pop(), most.pop()
                todo.pop()
                del place[node]
                depth[node] = found
                if most:
                    most[-1] = max(most[-1], 1 + found)
            elif said in out:
                left.append((said, to))
            elif to in place:
                most[-1] = max(most[-1], 1)
                ring = path[place[to] :]
                if len(ring) > 1:
                    turn = turned(ring, [_plain(x) for x in ring])
                    rings[tuple(turn)] = turn
            elif to in depth:
                most[-1] = max(most[-1], 1 + depth[to])
            else:
                path.append(to)
                place[to] = len(path) - 1
                todo.append(iter(targets.get(to, ())))
                most.append(beyond.get(to, 0))
    return [*rings.values()], depth, left


def _plain(node: str) -> str:
    """The id without its project."""
    return node.split(_BREAK, 1)[-1]


def _targets(edges: pd.DataFrame) -> dict[str, list[tuple[str, str]]]:
    out: dict[str, list[tuple[str, str]]] = {}
    for said, s, t in sorted(zip(edges["edge"], edges["source"], edges["target"], strict=True)):
        out.setdefault(s, []).append((said, t))
    return out


def _whole(pdf: pd.DataFrame) -> pd.DataFrame:
    rings, depth, _ = _walk(sorted({*pdf["source"], *pdf["target"]}), _targets(pdf), {})
    return pd.DataFrame([(k, v, None) for k, v in depth.items()] + [(None, None, r) for r in rings], columns=["id", "depth", "cycle"]).astype({"depth": "Int32"})


def _placed(pdf: pd.DataFrame) -> pd.DataFrame:
    """A component's nodes, its cycles, and the ways along the edges that lead out of it: the way to it and the edge's place among them.

    Rows without an edge are nodes with a way; those with a component (`to`) are edges that lead out.
    """
    nodes = pdf[pdf["edge"].isna()]
    way, first = min((list(w), n) for n, w in zip(nodes["source"], nodes["way"], strict=True))
    leading = pdf[pdf["to"].notna()]
    comps = dict(zip(leading["edge"], leading["to"], strict=True))
    rings, depth, left = _walk([first], _targets(pdf[pdf["edge"].notna()]), {}, comps)
    out = [(n, None, n == first, None, None) for n in depth] + [(None, None, None, r, None) for r in rings]
    return pd.DataFrame(out + [(t, [*way, f"{k:012d}"], None, None, comps[e]) for k, (e, t) in enumerate(left)], columns=["id", "way", "entry", "cycle", "to"])


def _deep(pdf: pd.DataFrame) -> pd.DataFrame:
    """The depths of a component's nodes. Rows without an edge are nodes with the depth beyond, and whether the search enters there."""
    nodes = pdf[pdf["edge"].isna()]
    beyond = dict(zip(nodes["source"], nodes["beyond"].astype(int), strict=True))
    _, depth, _ = _walk(nodes["source"][nodes["entry"].astype(bool)], _targets(pdf[pdf["edge"].notna()]), beyond)
    return pd.DataFrame([*depth.items()], columns=["id", "depth"])


class _Rounds:
    """Components freed one after the other: each when as many messages came as edges lead to it."""

    def __init__(self, parts: DataFrame, edges: DataFrame, best: Column):
        """parts: comp, id, ...; edges: comp (that messages come to), one row for each message; best: of a node's messages (`said`)."""
        self.due = stored(edges.groupBy("comp").agg(F.count(F.lit(1)).alias("due")), "due")
        self.parts, self.best, self.waiting = parts, best, None
        self.freed = parts.select("comp").distinct().join(self.due, "comp", "left_anti")
        self.said: DataFrame | None = None

    def nodes(self) -> DataFrame:
        """The freed components' nodes with the best message (null without one)."""
        now = self.parts.join(bounded(stored(self.freed, "freed")), "comp")
        return stored(now.withColumn("said", F.lit(None)) if self.said is None else now.join(self.said.select("id", "said"), "id", "left"), "now")

    def take(self, messages: DataFrame) -> None:
        """messages: comp, id, n, said."""
        new = messages if self.waiting is None else self.waiting.unionByName(messages)
        new = stored(new.groupBy("comp", "id").agg(F.sum("n").alias("n"), self.best.alias("said")), "waiting")
        self.freed = stored(new.groupBy("comp").agg(F.sum("n").alias("n")).join(self.due, "comp").where("n = due").select("comp"), "freed")
        free = bounded(self.freed)
        self.said, self.waiting = new.join(free, "comp", "left_semi"), new.join(free, "comp", "left_anti")


def _apart(edges: DataFrame) -> DataFrame:
    """edges: source, target, edge. id, depth, cycle."""
    found = strong_components(edges).withColumnRenamed("component", "comp")
    ids = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    parts = ids.join(found, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"), F.col("comp").isNotNull().alias("several"))
    loops = edges.where("source = target").select(F.col("source").alias("id"), F.lit(1).alias("loop"))
    parts = stored(parts.join(loops, "id", "left").withColumn("loop", F.coalesce("loop", F.lit(0))), "parts")
    ends = lambda side: parts.select(F.col("id").alias(side), F.col("comp").alias(f"{side}_comp"))
    known = stored(edges.join(ends("source"), "source").join(ends("target"), "target"), "known")
    inner = stored(known.where("source_comp = target_comp").select(F.col("source_comp").alias("comp"), "source", "target", "edge"), "inner")
    cross = stored(known.where("source_comp <> target_comp"), "cross")
    leading = cross.select(F.col("source_comp").alias("comp"), "source", "target", "edge", F.col("target_comp").alias("to"))
    placed, rings = [], []
    forth = _Rounds(parts, cross.select(F.col("target_comp").alias("comp")), F.min("said"))
    while True:
        now = forth.nodes()
        if now.isEmpty():
            break
        own = F.array("id")
        now = now.withColumn("way", F.least(own, F.coalesce(F.col("said").cast("array<string>"), own)))
        none = lambda kind: F.lit(None).cast(kind)
        group = now.where("several").select("comp", F.col("id").alias("source"), none("string").alias("target"), none("string").alias("edge"), "way", none("string").alias("to"))
        met = bounded(stored(group.select("comp").distinct(), "several"))
        group = group.unionByName(inner.select("*", none("string").alias("to")).unionByName(leading).join(met, "comp").withColumn("way", none("array<string>")))
        met = stored(group.groupBy("comp").applyInPandas(_placed, "id string, way array<string>, entry boolean, cycle array<string>, to string"), "met")
        rings.append(met.where("cycle IS NOT NULL").select("cycle"))
        alone = now.where("NOT several").select("id", "way")
        placed.append(alone.select("id", F.lit(True).alias("entry")).unionByName(met.where("entry IS NOT NULL").select("id", "entry")))
        on = alone.join(cross, alone["id"] == cross["source"]).select(F.col("target_comp").alias("comp"), F.col("target").alias("id"), F.lit(1).alias("n"), F.concat("way", F.array("edge")).alias("said"))
        forth.take(on.unionByName(met.where("to IS NOT NULL").select(F.col("to").alias("comp"), "id", F.lit(1).alias("n"), F.col("way").alias("said"))))
    entries = stored(_union(placed), "entries")
    parts = stored(parts.join(entries, "id"), "parts")
    depths = []
    back = _Rounds(parts, cross.select(F.col("source_comp").alias("comp")), F.max("said"))
    while True:
        now = back.nodes()
        if now.isEmpty():
            break
        now = now.withColumn("beyond", F.coalesce(F.col("said").cast("int"), F.lit(0)))
        group = now.where("several").select("comp", F.col("id").alias("source"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("edge"), "beyond", "entry")
        more = inner.join(bounded(stored(group.select("comp").distinct(), "several")), "comp")
        group = group.unionByName(more.withColumn("beyond", F.lit(None).cast("int")).withColumn("entry", F.lit(None).cast("boolean")))
        deep = group.groupBy("comp").applyInPandas(_deep, "id string, depth int")
        new = stored(now.where("NOT several").select("id", F.greatest("beyond", "loop").alias("depth")).unionByName(deep), "depths")
        depths.append(new)
        back.take(new.join(cross, new["id"] == cross["target"]).select(F.col("source_comp").alias("comp"), F.col("source").alias("id"), F.lit(1).alias("n"), (F.col("depth") + 1).alias("said")))
    return _union(depths).select("id", "depth", F.lit(None).cast("array<string>").alias("cycle")).unionByName(_union(rings).select(F.lit(None).cast("string").alias("id"), F.lit(None).cast("int").alias("depth"), "cycle"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def searched(edges: DataFrame, project: str = "project", most: int | None = None) -> DataFrame:
    """project, id, depth, cycle: a row for each node, with its depth, and one for each cycle (nodes, turned so that their joined ids come first).

    edges: project, source, target (strings). most: the edges of a graph that one task searches whole, SEARCHED without it. No edges, no rows.
    """
    most = SEARCHED if most is None else most
    own = stored(edges.select(F.col(project).cast("string").alias("project"), "source", "target").distinct().withColumn("edge", key("edge", F.col("source"), F.col("target"))), "search")
    sizes = stored(own.groupBy("project").agg(F.count(F.lit(1)).alias("size")), "sizes")
    small = own.join(bounded(sizes.where(F.col("size") <= most).select("project")), "project")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _whole(pdf)
        out.insert(0, "project", pdf["project"].iloc[0])
        return out

    done = stored(small.groupBy("project").applyInPandas(whole, "project string, id string, depth int, cycle array<string>"), "searched")
    large = sizes.where(F.col("size") > most).select("project")
    if large.isEmpty():
        return done.withColumnRenamed("project", project)
    # one graph of all, whose ids begin with their project
    named = lambda c: F.concat("project", F.lit(_BREAK), c)
    rest = own.join(bounded(large), "project").select(named("source").alias("source"), named("target").alias("target"), "edge")
    found = stored(_apart(stored(rest, "large")), "searched")
    first = F.coalesce("id", F.get("cycle", F.lit(0)))
    plain = lambda c: F.regexp_replace(c, f"^[^{_BREAK}]*{_BREAK}", "")
    more = found.select(F.substring_index(first, _BREAK, 1).alias("project"), plain(F.col("id")).alias("id"), "depth", F.transform("cycle", plain).alias("cycle"))
    return done.unionByName(more).withColumnRenamed("project", project)


def cycles(found: DataFrame, project: str = "project") -> DataFrame:
    """project, id, length, nodes; found: see searched."""
    rows = found.where("cycle IS NOT NULL")
    return rows.select(project, F.sha2(F.concat(F.lit("cycle:"), F.array_join("cycle", ":")), 256).alias("id"), F.size("cycle").alias("length"), F.col("cycle").alias("nodes"))


def depths(found: DataFrame, project: str = "project") -> DataFrame:
    """project, id, depth; found: see searched."""
    return found.where("id IS NOT NULL").select(project, "id", "depth")


def max_depth(found: DataFrame) -> DataFrame:
    """One row: max_depth, the greatest of a graph's nodes; 0 without edges."""
    return found.agg(F.coalesce(F.max("depth"), F.lit(0)).cast("int").alias("max_depth"))


def edge_key(source: str, target: str) -> str:
    """What orders a node's targets."""
    return hashlib.sha256(f"edge:{source}:{target}".encode()).hexdigest()
