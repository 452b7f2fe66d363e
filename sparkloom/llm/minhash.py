"""MinHash tries: candidates by shared prefixes of signatures, exact Jaccard verification in blocks.

A signature is a sequence of minima for each tree. `Forest` names the trie nodes on the path of a set, one for each depth of
`depths` (shallow to deep), by hashes of tree and prefix. `shared` brings the paths sorted to the tasks, so that a task holds one
row at a time and reads from neighbouring rows how deep a path is shared. A trie node that a sample shows to be hot is known to be
shared: its rows need not meet, and are dealt by the next deeper node, or by themselves.

`groups` makes trie nodes of equal texts, which near copies have in many trees, one group. A group is cut into blocks.

`verified` compares exactly every two texts of a group that don't share a group of a lesser name, and are compared there; it counts
links. No pair becomes a row: a task returns the number of links and one edge for each text. A group of n blocks sends each of its
texts n times, since all its pairs are asked for.

`connected` asks for the connected components alone. A block is compared with itself and with a hub, the group's least node; only the
texts that this doesn't connect with the hub, the rest, meet the other blocks. So near copies of one text, however many, are sent once
or twice; work grows with the square of the rest alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, map_arrow, stored
from .hashing import mix, ranges

DEPTH = 8
#: Texts, and elements of their sets, that a block has on average at most.
BLOCK_TEXTS, BLOCK_ITEMS = 256, 1_000_000
#: Texts that are looked at for hot trie nodes, about, and of these how many have a hot one. It decides where rows go, not what comes out.
HOT_SAMPLE, HOT_TEXTS = 20_000, 200
_LAST = np.iinfo(np.int64).max
_SALT = 64


def chance(similarity: float, depth: int, trees: int) -> float:
    """The probability that two sets of that similarity share a prefix of that depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_length(threshold: float, trees: int, recall: float, depth: int = DEPTH) -> int:
    """The longest prefix at which two sets of that similarity meet in some tree with that probability; 1 if none does."""
    return next((r for r in range(depth, 0, -1) if chance(threshold, r, trees) >= recall), 1)


class Forest:
    def __init__(self, threshold: float, trees: int, depths: tuple[int, ...]):
        self.threshold, self.trees, self.depths = threshold, trees, tuple(sorted(depths))
        r = np.random.default_rng(7)
        self.factors = r.integers(1, 1 << 31, trees * self.depths[-1], dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def paths(self, items: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The trie nodes of each set, as 64-bit hashes of tree and prefix: (sets, trees, depths). Sets must not be empty."""
        low = (items >> np.uint64(20)).astype(np.uint32)
        out = np.empty((len(offsets) - 1, self.trees, len(self.depths)), np.uint64)
        for t in range(self.trees):
            key = np.full(len(out), t + 1, np.uint64)
            for k in range(self.depths[-1]):
                key = mix(key ^ np.minimum.reduceat(low * self.factors[t * self.depths[-1] + k], offsets[:-1]).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
                if k + 1 in self.depths:
                    out[:, t, self.depths.index(k + 1)] = mix(key)
        return out


def _path_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c[0] == "p" and c[1:].isdigit()]


def hot_keys(keyed: DataFrame) -> DataFrame:
    """keyed: p0, p1 ..., node, of a sample of the texts. key: the trie nodes that many of them have; as many as fit HOT_SAMPLE / HOT_TEXTS, times trees and depths."""
    rows = keyed.select(F.explode(F.array(*_path_columns(keyed))).alias("key"), "node").distinct()
    return stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_TEXTS).select("key"), "hot")


def shared(keyed: DataFrame, hot: DataFrame) -> DataFrame:
    """keyed: p0, p1 ... (shallow to deep), node. level (from 1), key, node: the distinct rows of those trie nodes that several texts have."""
    path = _path_columns(keyed)
    if hot.isEmpty():
        dealt = keyed.select(*path, "node", F.lit(0).alias("known")).repartition("p0")
    else:
        for i, p in enumerate(path):
            keyed = keyed.join(F.broadcast(hot.select(F.col("key").alias(p), F.lit(True).alias(f"h{i}"))), p, "left")  # HOT_SAMPLE bounds it
        known, part = F.lit(len(path)), F.xxhash64(path[-1], F.pmod("node", F.lit(_SALT)))
        for i in range(len(path) - 1, -1, -1):
            known, part = F.when(F.col(f"h{i}").isNull(), i).otherwise(known), F.when(F.col(f"h{i}").isNull(), F.col(path[i])).otherwise(part)
        dealt = keyed.select(*path, "node", known.cast("int").alias("known"), part.alias("part")).repartition("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[np.ndarray, np.ndarray, np.ndarray, int] | None = None  # the row before: path, node, known, depth shared with the row before it

        def told(p: np.ndarray, node: np.ndarray, depth: np.ndarray) -> Iterator[pa.RecordBatch]:
            for level in range(1, p.shape[1] + 1):
                on = depth >= level
                if on.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(on.sum(), level, np.int32)), pa.array(p[on, level - 1]), pa.array(node[on])], names=["level", "key", "node"])

        for batch in batches:
            if not len(batch):
                continue
            p = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in path], 1)
            node, known = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "known"))
            before = 0
            if last is not None:
                p, node, known, before = np.concatenate([last[0], p]), np.concatenate([last[1], node]), np.concatenate([last[2], known]), last[3]
            if p.shape[1] == 1:  # the first row's key stays the least, so what it shares with the row before holds for whichever is first
                order = np.lexsort((node, p[:, 0]))
                p, node, known = p[order], node[order], known[order]
            new = np.ones(len(p), bool)
            new[1:] = (node[1:] != node[:-1]) | (p[1:] != p[:-1]).any(1)
            p, node, known = p[new], node[new], known[new]
            both = np.cumprod(p[1:] == p[:-1], axis=1).sum(1)
            left = np.concatenate([[before], both])
            depth = np.maximum(np.maximum(left[:-1], both), known[:-1])
            yield from told(p[:-1], node[:-1], depth)
            last = p[-1:], node[-1:], known[-1:], int(left[-1])
        if last is not None:
            yield from told(last[0], last[1], np.maximum(last[2], last[3]))

    # Spark sorts by one number in linear time; the tasks order nodes by batches, and a row that comes again in a later one is dropped behind them
    by = path if len(path) == 1 else [*path, "node"]
    found = map_arrow(dealt.sortWithinPartitions(*by).select(*path, "node", "known"), run, "level int, key long, node long")
    return found.distinct() if len(path) == 1 else found


def groups(rows: DataFrame, round_: int = 0) -> DataFrame:
    """rows: key, node, of shared keys. group, node: keys of the same nodes are one group, named by the round and a hash of the nodes."""
    nodes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    name = F.lit(round_ << 58).cast("long").bitwiseOR(F.shiftrightunsigned(F.xxhash64("n", "x", "y"), 6))
    named = stored(nodes.select("key", name.alias("group")), "groups")  # a plain side, so that hot keys can be split
    return rows.join(named, "key").select("group", "node").distinct()


def members(grouped: DataFrame, nodes: DataFrame, links: bool, earlier: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """grouped: group, node; nodes: node, n_items and more; earlier: names of earlier rounds.

    Rows of both with n_blocks and hub (the least node) of the group, the row's block, and `groups`: the names of those groups of the
    node, of this and earlier rounds, in which all pairs are compared (without links, groups of one block). And those names: group, node.
    """
    known = stored(grouped.join(nodes, "node"), "known")
    n = F.greatest(F.count(F.lit(1)) / BLOCK_TEXTS, F.sum("n_items") / BLOCK_ITEMS, F.lit(1.0))
    size = stored(known.groupBy("group").agg(F.ceil(n).cast("int").alias("n_blocks"), F.min("node").alias("hub")), "sized")
    both = known.join(size, "group")
    names = stored((both if links else both.where("n_blocks = 1")).select("group", "node"), "names")
    every = names if earlier is None else names.unionByName(earlier)
    held = every.groupBy("node").agg(F.collect_set("group").alias("groups"))  # as many as trees and rounds at most
    return both.join(held, "node", "left").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")), every


#: Makes from texts and nodes: the places of the texts that have sets, and their elements (sorted, distinct) and offsets.
Make = Callable[[pa.Array, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
_LINKS = "a long, b long, links long"


def verified(texts: DataFrame, threshold: float, make: Make) -> DataFrame:
    """texts: members with weight and text. Rows a, b, links, some for each node with links.

    b is a node that a is connected with; links adds up to the weights of all nodes linked with a. The texts travel, being smaller than
    their sets, which `make` makes in the tasks.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    dealt = texts.withColumn("_o", other).withColumn("_i", F.least("block", "_o")).withColumn("_j", F.greatest("block", "_o")).withColumn("order", F.col("group"))
    return _compare(dealt, threshold, make)


def connected(proposed: DataFrame, texts: DataFrame, threshold: float, make: Make) -> DataFrame:
    """The same rows, but of as many links only as connect what is connected. proposed: members without links; texts: those with weight and text."""
    big = F.col("n_blocks") > 1
    here = F.when(big & (F.col("node") == F.col("hub")), F.sequence(F.lit(0), F.col("n_blocks") - 1)).otherwise(F.array("block"))
    order = F.when(big, F.lit(int(_LAST))).otherwise(F.col("group")).alias("order")
    columns = ["group", "node", "weight", "groups", "text"]
    first = texts.withColumn("_i", F.explode(here)).select(*columns, "_i", F.col("_i").alias("_j"), F.col("_i").alias("block"), order)
    links = stored(_compare(first, threshold, make), "links")
    large = stored(proposed.where(big).select("group", "node", "block", "n_blocks", "hub"), "large")
    if large.isEmpty():
        return links
    # the least of a connected part of a block is the hub, if that is in it
    joined = links.select(F.col("a").alias("node"), F.col("b").alias("hub"), F.lit(False).alias("rest")).distinct()
    of = stored(large.join(joined, ["node", "hub"], "left").withColumn("rest", F.coalesce("rest", F.col("node") != F.col("hub"))), "hubs")
    most = stored(of.groupBy("group").agg(F.count_if("rest").alias("n")).where("n > 0").select("group", F.ceil(F.col("n") / BLOCK_TEXTS).cast("int").alias("n_rest")), "rest")
    if most.isEmpty():
        return links
    of = of.join(bounded(most), "group")
    mine = F.pmod(F.xxhash64("node", F.lit(2)), F.col("n_rest")).cast("int")
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # a block of the rest is numbered from -1 down, so that it can't be one of the others
    with_rest = F.transform(to("n_rest"), lambda i: F.struct((-1 - F.greatest(i, mine)).alias("i"), (-1 - F.least(i, mine)).alias("j")))
    with_others = F.transform(to("n_blocks"), lambda i: F.struct((-1 - mine).alias("i"), i.alias("j")))
    others_with = F.transform(to("n_rest"), lambda i: F.struct((-1 - i).alias("i"), F.col("block").alias("j")))
    tasks = F.explode(F.when(F.col("rest"), F.concat(with_rest, with_others)).otherwise(others_with))
    pairs = of.withColumn("t", tasks).select("group", "node", F.col("t.i").alias("_i"), F.col("t.j").alias("_j"), F.when(F.col("rest"), -1 - mine).otherwise(F.col("block")).alias("_block"))
    second = texts.where(big).select(*columns, order).join(stored(pairs, "second"), ["group", "node"]).withColumnRenamed("_block", "block")
    return links.unionByName(stored(_compare(second, threshold, make), "links"))


def _compare(dealt: DataFrame, threshold: float, make: Make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            ids = np.stack([t.column(c).to_numpy() for c in ("group", "_i", "_j")]) if len(t) else np.zeros((3, 0), np.int64)
            ends = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
            last = int(ends[-1]) if len(ends) else 0
            if last:
                yield from _compared(t.slice(0, last), np.append(0, ends), threshold, make)
            rest = t.slice(last)
        if rest is not None and len(rest):
            yield from _compared(rest, np.array([0, len(rest)]), threshold, make)

    dealt = dealt.select("group", "_i", "_j", "block", "node", "weight", "order", "groups", "text")
    return map_arrow(dealt.repartition("group", "_i", "_j").sortWithinPartitions("group", "_i", "_j"), run, _LINKS)


def _compared(t: pa.Table, ends: np.ndarray, threshold: float, make: Make) -> Iterator[pa.RecordBatch]:
    """The links of the groups whose rows stand between the ends."""
    t = t.combine_chunks()
    # two texts that are compared in a lesser group too need no sets here
    told, every = t.column("order").to_numpy(), [x or [] for x in t.column("groups").chunk(0).to_pylist()]
    elsewhere = lambda x, y, order: min({*x} & {*y}, default=_LAST) < order
    pair = ends[:-1][np.diff(ends) == 2]
    idle = np.array([x for x in pair.tolist() if elsewhere(every[x], every[x + 1], told[x])], np.int64)
    if len(idle):
        keep = np.ones(len(t), bool)
        keep[idle] = keep[idle + 1] = False
        ends = np.append(0, np.cumsum(keep))[ends]
        t = t.filter(pa.array(keep)).combine_chunks()
        if not len(t):
            return
    rows, flat, at = make(t.column("text").chunk(0), t.column("node").to_numpy())
    where = np.searchsorted(rows, ends)
    # texts of one id can differ and yet have one set, which counts once
    part, node = np.repeat(np.arange(len(where) - 1), np.diff(where)), t.column("node").to_numpy()[rows]
    order = np.lexsort((node, part))
    again = order[1:][(part[order[1:]] == part[order[:-1]]) & (node[order[1:]] == node[order[:-1]])]
    if len(again):
        first = np.ones(len(rows), bool)
        first[again] = False
        n = np.diff(at)
        rows, flat, at = rows[first], flat[np.repeat(first, n)], np.concatenate([[0], np.cumsum(n[first])])
        where = np.searchsorted(rows, ends)
    node, weight, block, last = (t.column(c).to_numpy()[rows] for c in ("node", "weight", "block", "order"))
    count, whole = np.diff(where), np.diff(ends)
    found = [*_pairs(where[:-1][(count == 2) & (whole == 2)], node, weight, flat, at, threshold)]  # most groups; none of these is compared elsewhere
    several = np.flatnonzero((count >= 2) & (whole > 2))
    names = [x or [] for x in t.column("groups").chunk(0).take(pa.array(rows)).to_pylist()] if len(several) else []
    for lo, hi in zip(where[:-1][several], where[1:][several], strict=True):
        items = [flat[x:y] for x, y in zip(at[lo:hi], at[lo + 1 : hi + 1], strict=True)]
        found.append(_block(node[lo:hi], weight[lo:hi], block[lo:hi], names[lo:hi], int(last[lo]), items, threshold))
    if found:
        a, b, links = (np.concatenate(x) for x in zip(*found, strict=True))
        on = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[on].astype(np.int64)) for x in (a, b, links)], names=["a", "b", "links"])


def _pairs(first: np.ndarray, node: np.ndarray, weight: np.ndarray, flat: np.ndarray, at: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """The links between the rows at `first` and those after them, many at once: of a pair and an element in one number, equal ones are shared."""
    for lo in (first[i : i + 4096] for i in range(0, len(first), 4096)):
        size = at[lo + 2] - at[lo]
        both = np.sort(np.repeat(np.arange(len(lo), dtype=np.uint64) << np.uint64(52), size) | flat[ranges(at[lo], size)])
        n = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(52)).astype(np.int64), minlength=len(lo))
        on = (n >= threshold * (size - n) - 1e-9) & (node[lo] != node[lo + 1])
        lo = lo[on]
        if len(lo):
            low = np.minimum(node[lo], node[lo + 1])
            yield np.concatenate([node[lo], node[lo + 1]]), np.concatenate([low, low]), np.concatenate([weight[lo + 1], weight[lo]])


def _block(node: np.ndarray, weight: np.ndarray, block: np.ndarray, names: list[list[int]], group: int, items: list[np.ndarray], threshold: float) -> tuple[np.ndarray, ...]:
    """One block with itself, or two with each other: the nodes, the least node that each is connected with, and the links' weights."""
    left = np.flatnonzero(block == block.min())
    one = len(left) == len(block)
    right = left if one else np.flatnonzero(block == block.max())
    met = node[left][:, None] != node[right][None, :]
    lesser: dict[int, list[int]] = {}
    for r, gs in enumerate(names):
        for g in gs:
            if g < group:
                lesser.setdefault(g, []).append(r)
    place_l, place_r = (np.full(len(node), -1) for _ in range(2))
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    for rows in lesser.values():
        if len(rows) > 1:  # these are compared in that group
            x, y = place_l[rows], place_r[rows]
            met[np.ix_(x[x >= 0], y[y >= 0])] = False
    size = np.array([len(x) for x in items], np.int64)
    both = _shared([items[x] for x in left], [items[x] for x in right], met)
    union = size[left][:, None] + size[right][None, :] - both
    linked = met & (both >= threshold * union - 1e-9)
    low_l, low_r = node[left].copy(), node[right].copy()
    while linked.any():
        new_l = np.minimum(low_l, np.where(linked, low_r[None, :], _LAST).min(axis=1))
        new_r = np.minimum(low_r, np.where(linked, new_l[:, None], _LAST).min(axis=0))
        if (new_l == low_l).all() and (new_r == low_r).all():
            break
        low_l, low_r = new_l, new_r
    sides = [(node[left], low_l, linked @ weight[right])]
    if not one:
        sides.append((node[right], low_r, linked.T @ weight[left]))
    return tuple(np.concatenate(x) for x in zip(*sides, strict=True))


def _shared(left: list[np.ndarray], right: list[np.ndarray], met: np.ndarray) -> np.ndarray:
    """How many elements two sets share, for the pairs in `met` at least."""
    out = np.zeros(met.shape, np.int64)
    pairs = np.argwhere(met)
    if len(pairs) <= 4 * (len(left) + len(right)):
        for x, y in pairs:
            out[x, y] = len(np.intersect1d(left[x], right[y], assume_unique=True))
        return out
    # many pairs: the product of the sets' 0/1 matrices, over elements that more than one set has, some columns at a time
    flat = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    on = count[column] > 1
    row, column = row[on], rank[column[on]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        a, b = np.searchsorted(column, (at, at + 2048))
        m = np.zeros((len(left) + len(right), 2048), np.float32)
        m[row[a:b], column[a:b] - at] = 1
        out += (m[: len(left)] @ m[len(left) :].T).astype(np.int64)
    return out
