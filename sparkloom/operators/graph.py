"""The dependency graph: edges, nodes, degrees, orphans, statistics, traversal, components, depth and cycles (the ordered search is in search.py).

Nodes have an id; edges have source and target. Iterations run as joins on the frontier alone, each round stored in the shared
folder; nothing but counts comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import key
from ..functions.order import ranked
from ..functions.session import bounded, dropped, shipped, stored

#: Edges that a task contracts at once.
CONTRACTED = 1 << 20
#: Rows that a task counts.
TASK_ROWS = 1 << 19


def upsert_edges(statements: DataFrame) -> DataFrame:
    """statements: source, target, is_dynamic, is_broken, is_external. One edge for each pair; dynamic if one of its statements is."""
    return statements.groupBy("source", "target").agg(F.bool_or("is_dynamic").alias("is_dynamic"), F.bool_or("is_broken").alias("is_broken"), F.bool_or("is_external").alias("is_external")).withColumn("id", key("edge", F.col("source"), F.col("target")))


def node_union(modules: DataFrame, found: DataFrame) -> DataFrame:
    """The modules and the missing or package nodes that edges lead to; of equal ids the module."""
    columns, told = ["id", "label", "path", "type"], "metadata" in modules.columns and "metadata" in found.columns
    more = [F.to_json("metadata").alias("metadata")] if told else []  # variants have no order
    both = modules.select(*columns, *more, F.lit(0).alias("_o")).unionByName(found.select(*columns, *more, F.lit(1).alias("_o")))
    rest = [*columns[1:], *(["metadata"] if told else [])]
    out = both.groupBy("id").agg(F.min(F.struct("_o", *rest)).alias("n")).select("id", *(F.col(f"n.{c}").alias(c) for c in rest))
    return out.withColumn("metadata", F.parse_json("metadata")) if told else out


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out: each edge counts once, self-loops on both sides."""
    ends = edges.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    sums = ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def adjacency(edges: DataFrame) -> DataFrame:
    """id, children, parents: sorted sets."""
    out = edges.groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_set("target")).alias("children"))
    back = edges.groupBy(F.col("target").alias("id")).agg(F.array_sort(F.collect_set("source")).alias("parents"))
    return out.join(back, "id", "full")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes without any edge; a self-loop is one."""
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
    return nodes.join(ends, "id", "left_anti")


def _parts(df: DataFrame) -> int:
    """How many partitions df asks for by its rows: as many as the session has, or more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: duplicate_nodes, duplicate_edges, dangling_edges; all are 0 in a sound graph.

    Rows are dealt out before they are counted, as many to a task as TASK_ROWS says: most keys are unique, so counting before a shuffle holds
    whatever a task reads. Edges move once by source, and then as sums by target.
    """
    parts = max(_parts(nodes), _parts(edges))
    ids = stored(nodes.select("id").repartition(parts, "id").groupBy("id").agg(F.count(F.lit(1)).alias("times")), "ids")
    known = ids.select("id").repartition(parts, "id")
    pairs = edges.select("source", "target").repartition(parts, "source").groupBy("source", "target").agg(F.count(F.lit(1)).alias("times"))
    found = pairs.join(known, pairs["source"] == known["id"], "left").groupBy("target", F.col("id").isNotNull().alias("known")).agg(F.sum("times").alias("times"), F.sum(F.col("times") - 1).alias("again"))
    found = stored(found, "targets")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    led = found.where("known").repartition(parts, "target")
    lost = led.join(known, led["target"] == known["id"], "left_anti").agg(total("times", "lost"))
    told = ids.agg(total(F.col("times") - 1, "duplicate_nodes")).crossJoin(found.agg(total("again", "duplicate_edges"), total(F.when(~F.col("known"), F.col("times")), "sourceless"))).crossJoin(lost)
    return told.select("duplicate_nodes", "duplicate_edges", (F.col("sourceless") + F.col("lost")).alias("dangling_edges"))


def children(edges: DataFrame, node: str | int) -> DataFrame:
    return edges.where(F.col("source") == F.lit(node)).select(F.col("target").alias("id")).distinct().orderBy("id")


def parents(edges: DataFrame, node: str | int) -> DataFrame:
    return edges.where(F.col("target") == F.lit(node)).select(F.col("source").alias("id")).distinct().orderBy("id")


def reachable(edges: DataFrame, start: str | int, backward: bool = False) -> DataFrame:
    """id: what start depends on (backward: what depends on it) over any number of steps; itself only if a cycle leads back."""
    a, b = ("target", "source") if backward else ("source", "target")
    steps = edges.select(F.col(a).alias("a"), F.col(b).alias("id")).distinct()
    frontier = seen = stored(steps.where(F.col("a") == F.lit(start)).select("id").distinct(), "reach")
    while not frontier.isEmpty():
        frontier = stored(steps.join(bounded(frontier.withColumnRenamed("id", "a")), "a").select("id").distinct().join(seen, "id", "left_anti"), "reach")
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, start: str | int, end: str | int) -> DataFrame:
    """step, id: a shortest path, of several the one whose nodes were met first with neighbours in id order; no rows without one.

    A level's nodes have their place in the breadth-first queue as a number, counted anew for each level from the parent's place and
    the id. The way back doubles its jumps, so that it takes as many rounds as the path's length has bits.
    """
    spark, kind = edges.sparkSession, dict(edges.dtypes)["source"]
    at = lambda v: F.lit(v).cast(kind)
    first = spark.range(1).select(at(start).alias("id"), at(None).alias("parent"), F.lit(0).cast("long").alias("place"))
    if start == end:
        return first.select(F.lit(0).alias("step"), "id")
    steps = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a <> b").distinct()
    frontier, seen, length, found = first, first, 0, False
    while not found and not frontier.isEmpty():
        nexts = steps.join(bounded(frontier.select(F.col("id").alias("a"), "place")), "a").groupBy(F.col("b").alias("id")).agg(F.min(F.struct("place", "a")).alias("p"))
        nexts = nexts.join(seen.select("id"), "id", "left_anti").select("id", F.col("p.a").alias("parent"), F.col("p.place").alias("above"))
        frontier = stored(ranked(nexts, "above", "id", name="place").select("id", "parent", "place"), "path")
        seen, length = seen.unionByName(frontier), length + 1
        found = not frontier.where(F.col("id") == at(end)).isEmpty()
    if not found:
        return spark.createDataFrame([], f"step int, id {kind}")
    jump = stored(seen.where("parent IS NOT NULL").select("id", F.col("parent").alias("to")), "jump")
    path = spark.range(1).select(F.lit(length).alias("step"), at(end).alias("id"))
    for k in range(length.bit_length()):
        back = jump.join(bounded(path), "id").select((F.col("step") - (1 << k)).alias("step"), F.col("to").alias("id"))  # a path's nodes
        path = stored(path.unionByName(back), "path")
        if 2 << k <= length:
            jump = stored(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("further")), "to").select("id", F.col("further").alias("to")), "jump")
    return path.where("step >= 0").distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return r[0], r[1]


def _roots(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By node, numbered from 0, the least that edges a, b connect it with."""
    up = np.arange(nodes)
    while True:
        x, y = up[a], up[b]
        if (x == y).all():
            return up
        least = np.minimum(x, y)
        np.minimum.at(up, x, least)
        np.minimum.at(up, y, least)
        while (up[up] != up).any():
            up = up[up]


def contracted(edges: DataFrame) -> DataFrame:
    """edges: a, b. As many of the edges of each task, CONTRACTED at once, as connect what these connect: a, and b, the least node of them."""
    schema = edges.select("a", "b").schema

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        # Arrow numbers the nodes by a hash, and only different ones are sorted; its strings are in Spark's order, of bytes
        both = pa.concat_arrays([*t.column("a").chunks, *t.column("b").chunks]).dictionary_encode()
        order = pc.sort_indices(both.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = place[both.indices.to_numpy()]
        root = _roots(len(order), at[: len(t)], at[len(t) :])
        on = np.flatnonzero(root != np.arange(len(order)))
        return pa.RecordBatch.from_arrays([both.dictionary.take(pa.array(order[x])) for x in (on, root[on])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= CONTRACTED:
                yield stars(held)
                held, n = [], 0
        if n:
            yield stars(held)

    shipped(edges.sparkSession)
    return edges.select("a", "b").mapInArrow(run, schema)


def star_components(edges: DataFrame) -> DataFrame:
    """edges: a, b of one type (repeats, loops and either direction allowed). node, component (its least node); no edges, no rows.

    Union-find: tasks contract their own edges to stars, then large-star and small-star steps follow until no edge changes. Every step is a minimum by key, taken before the shuffle too,
    and a join with those minima; no component meets in one task and nothing but two numbers comes to the driver. Each round's edges
    are stored in the shared folder, so a lost executor costs little, and those of the round before are deleted.
    """
    own = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    # by ranges: what hangs together often has ids near each other, and a hub's edges are shared out
    now = stored(contracted(stored(own, "own").repartitionByRange("b", "a")).distinct(), "edges")
    told = _state(now)
    while told[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # stored, so that both sides of the join are plain shuffles, whose hot keys Spark can split
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(lower.select("a", F.col("m").alias("b"))).distinct()
        after = stored(contracted(small).distinct(), "edges")
        dropped(least)
        before, told, done = told, _state(after), now
        now = after
        dropped(done)
        if told == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the least id that edges of either direction lead to."""
    found = star_components(edges.select(F.col("source").alias("a"), F.col("target").alias("b"))).withColumnRenamed("node", "id")
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def depths(edges: DataFrame) -> DataFrame:
    """id, depth: the edges on the longest path that ends there, from the sources on. Raises on a cycle, for which there is search.depths.

    Nodes are freed when all that lead to them are done; a round touches the freed ones and those that wait for more.
    """
    steps = stored(edges.select("source", "target").distinct(), "steps")
    due = stored(steps.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("due")), "due")
    ids = steps.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    now = done = stored(ids.join(due, "id", "left_anti").withColumn("depth", F.lit(0)), "level")
    waiting = due.limit(0).select("id", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("n"))
    while not now.isEmpty():
        said = steps.join(bounded(now.select(F.col("id").alias("source"), "depth")), "source").select(F.col("target").alias("id"), F.col("depth") + 1, F.lit(1).cast("long"))
        told = stored(waiting.union(said).groupBy("id").agg(F.max("depth").alias("depth"), F.sum("n").alias("n")).join(due, "id"), "told")
        now = told.where("n = due").select("id", "depth")
        waiting = told.where("n < due").select("id", "depth", "n")
        done = done.unionByName(now)
    if not waiting.isEmpty() or done.isEmpty() and not steps.isEmpty():
        raise ValueError("the graph has a cycle; see search.depths")
    return done


def max_depth(edges: DataFrame) -> DataFrame:
    """One row: max_depth; 0 without edges."""
    return depths(edges).agg(F.coalesce(F.max("depth"), F.lit(0)).cast("int").alias("max_depth"))


def statistics(nodes: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """One row: nodes, edges, orphans, components, average_fan_in, average_fan_out."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    row = count(nodes, "nodes").crossJoin(count(edges, "edges")).crossJoin(count(orphans(nodes, edges), "orphans")).crossJoin(components.agg(F.countDistinct("component").alias("components")))
    average = F.when(F.col("nodes") == 0, F.lit(0.0)).otherwise(F.col("edges") / F.greatest("nodes", F.lit(1)))
    return row.withColumn("average_fan_in", average).withColumn("average_fan_out", average)


def _strong(pdf: pd.DataFrame) -> pd.DataFrame:
    """id, component: the strong components of several nodes among these edges, by one search that keeps its own stack."""
    nodes, at = np.unique(np.concatenate([pdf["source"].to_numpy(), pdf["target"].to_numpy()]), return_inverse=True)
    n, m = len(nodes), len(pdf)
    order = np.argsort(at[:m], kind="stable")
    to, begin = at[m:][order].tolist(), np.searchsorted(at[:m][order], np.arange(n + 1)).tolist()
    nexts, number, low, comp, held, met = begin[:n], [-1] * n, [0] * n, [-1] * n, [], 0
    for first in range(n):
        if number[first] >= 0:
            continue
        path = [first]
        while path:
            v = path[-1]
            if number[v] < 0:
                number[v] = low[v] = met
                met += 1
                held.append(v)
            if nexts[v] < begin[v + 1]:
                w = to[nexts[v]]
                nexts[v] += 1
                if number[w] < 0:
                    path.append(w)
                elif comp[w] < 0:
                    low[v] = min(low[v], number[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == number[v]:
                k = len(held) - 1
                while held[k] != v:
                    k -= 1
                least = min(held[k:])
                for w in held[k:]:
                    comp[w] = least
                del held[k:]
    found = np.array(comp)
    several = np.bincount(found, minlength=n)[found] > 1
    return pd.DataFrame({"id": nodes[several], "component": nodes[found[several]]})


def strong_components(edges: DataFrame, most: int = CONTRACTED) -> DataFrame:
    """id, component: the strongly connected components of more than one node.

    Edges that hang together in either direction are searched in one task if they are at most `most`, however long their ways are; the
    number of rounds that finds what hangs together grows with the logarithm of that length. Larger ones are taken apart by `_peeled`.
    """
    own = stored(edges.select("source", "target").where("source <> target").distinct(), "own")
    kind = own.schema["source"].dataType.simpleString()
    group = star_components(own.select(F.col("source").alias("a"), F.col("target").alias("b"))).select(F.col("node").alias("source"), F.col("component").alias("_group"))
    told = stored(own.join(group, "source"), "told")
    sizes = stored(told.groupBy("_group").agg(F.count(F.lit(1)).alias("_size")), "sizes")
    small = told.join(bounded(sizes.where(F.col("_size") <= most).select("_group")), "_group")
    shipped(edges.sparkSession)
    done = stored(small.groupBy("_group").applyInPandas(_strong, f"id {kind}, component {kind}"), "component")
    large = sizes.where(F.col("_size") > most).select("_group")
    return done if large.isEmpty() else done.unionByName(_peeled(told.join(bounded(large), "_group").select("source", "target")))


def _peeled(edges: DataFrame) -> DataFrame:
    """The same by trimming, then forward labels and backward reach, with no group in one task.

    A round labels every node with the least node that reaches it; of each label the nodes that reach the node of that name are one
    component. They go, what is left is trimmed of nodes without a way in or out, and so on.
    """
    left = stored(edges.select("source", "target").where("source <> target").distinct(), "left")
    found: list[DataFrame] = []
    while True:
        while True:  # trim
            inner = stored(left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"), "left")
            same = inner.count() == left.count()
            left = inner
            if same:
                break
        if left.isEmpty():
            break
        color = stored(left.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("color", F.col("id")), "color")
        while True:
            near = left.join(color, left["source"] == color["id"]).groupBy(F.col("target").alias("id")).agg(F.min("color").alias("near"))
            after = stored(color.join(near, "id", "left").select("id", F.least("color", F.coalesce("near", "color")).alias("color"), F.col("color").alias("was")), "color")
            moved = not after.where("color <> was").isEmpty()
            color = after.select("id", "color")
            if not moved:
                break
        inside = left.join(color.select(F.col("id").alias("source"), F.col("color").alias("c")), "source").join(color.select(F.col("id").alias("target"), F.col("color").alias("d")), "target").where("c = d").select("source", "target", "c")
        inside = stored(inside, "inside")
        front = back = stored(color.where("id = color").select("id", F.col("color").alias("c")), "back")
        while not front.isEmpty():
            front = stored(inside.join(front.withColumnRenamed("id", "target"), ["target", "c"]).select(F.col("source").alias("id"), "c").distinct().join(back, ["id", "c"], "left_anti"), "back")
            back = back.unionByName(front)
        back = stored(back, "component")
        found.append(back.select("id", F.col("c").alias("component")))
        gone = back.select("id")
        left = stored(left.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti").select("source", "target"), "left")
    if not found:
        return edges.select(F.col("source").alias("id"), F.col("source").alias("component")).limit(0)
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    several = out.groupBy("component").count().where("count > 1").select("component")
    return out.join(several, "component", "left_semi").select("id", "component")


def functional_cycles(edges: DataFrame) -> DataFrame:
    """cycle (ids, the least first), length: of a graph in which each node has one edge out at most; all of them, by pointer doubling.

    After the doubling every node points into a cycle; the nodes pointed at are those of the cycles. A cycle's nodes are then put
    in order along the edges from its least, so a cycle is one row.
    """
    step = stored(edges.where("source <> target").select(F.col("source").alias("id"), F.col("target").alias("to")), "step")
    jump, known, n = step, step.select("id", F.col("to").alias("least")), step.count()
    for _ in range(max(1, n.bit_length())):
        on = jump.select(F.col("id").alias("to"), F.col("to").alias("further"))
        low = known.select(F.col("id").alias("to"), F.col("least").alias("low"))
        both = stored(jump.join(known, "id").join(on, "to").join(low, "to").select("id", F.col("further").alias("to"), F.least("least", "low").alias("least")), "jump")
        jump, known = both.select("id", "to"), both.select("id", "least")
    on_cycle = stored(jump.select(F.col("to").alias("id")).distinct().join(known, "id"), "on-cycle")
    ring = stored(step.join(on_cycle, "id").select("id", "to", "least"), "ring")
    walk = ring.where("id = least").select(F.col("least"), F.array("id").alias("cycle"), "to")
    out: list[DataFrame] = []
    while True:
        walk = stored(walk, "walk")
        out.append(walk.where(F.col("to") == F.col("least")).select("cycle"))
        rest = walk.where(F.col("to") != F.col("least"))
        if rest.isEmpty():
            break
        nexts = ring.select(F.col("id").alias("at"), F.col("to").alias("next"))
        walk = rest.join(nexts, F.col("to") == F.col("at")).select("least", F.concat("cycle", F.array("at")).alias("cycle"), F.col("next").alias("to"))
    done = out[0]
    for df in out[1:]:
        done = done.unionByName(df)
    return done.withColumn("length", F.size("cycle"))


def turned(cycle: list[str], names: list[str]) -> list[str]:
    """The rotation of a cycle whose joined names come first, of equal ones the first: compared by beginnings that double until one is least."""
    text = "".join(names)
    starts = np.cumsum([0, *map(len, names)]).tolist()[:-1]
    twice, left, n = text + text, list(range(len(names))), 16
    while len(left) > 1:
        said = [twice[starts[i] : starts[i] + min(n, len(text))] for i in left]
        least = min(said)
        left = [i for i, x in zip(left, said, strict=True) if x == least]
        if n >= len(text):
            break
        n *= 2
    return cycle[left[0] :] + cycle[: left[0]]


def canonical(cycle: Column) -> Column:
    """The rotation of a cycle whose joined ids come first."""
    turns = F.transform(F.sequence(F.lit(1), F.size(cycle)), lambda i: F.concat(F.slice(cycle, i, F.size(cycle)), F.slice(cycle, F.lit(1), i - 1)))
    return F.array_min(F.transform(turns, lambda t: F.struct(F.array_join(F.transform(t, lambda x: x.cast("string")), "").alias("k"), t.alias("t"))))["t"]


def node_group(path: Column, kind: Column) -> Column:
    """The group of a node on a map: by kind if it is no module, else src and the directory below, or the first directory."""
    parts = F.split(path, "/", -1)
    deep = F.when((F.get(parts, F.lit(0)) == "src") & (F.size(parts) > 2), F.concat(F.lit("src/"), F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(0)))
    return F.when(kind == "package", F.lit("packages")).when(kind == "missing", F.lit("missing")).otherwise(deep)


def group_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """source_group, target_group, n: edges between different groups. groups: id, group."""
    a, b = groups.select(F.col("id").alias("source"), F.col("group").alias("source_group")), groups.select(F.col("id").alias("target"), F.col("group").alias("target_group"))
    return edges.join(a, "source").join(b, "target").where("source_group <> target_group").groupBy("source_group", "target_group").agg(F.count(F.lit(1)).alias("n"))
