"""N-gram Jaccard join: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Words stand between ASCII white space and are taken unchanged; a text of one to four words has one shingle, an empty one none.
Texts of equal shingle sets are one class, counted before anything is compared. A MinHash LSH forest proposes: the signatures stand
sorted in prefix tries, one for each tree; texts that share a prefix of DEEPEST are compared first. As long as a pair of exactly the
threshold would be found with a chance of less than RECALL, prefixes are shortened by STEP, and what meets there and didn't before
is compared. So the chance that a link is found is RECALL or more, whatever else is in the table. The sets of 52-bit shingle hashes
decide.

Result, one row for each input row: doc_id, class_id (the least doc_id that it is connected with by links, its own if none),
n_links (the other rows at 0.8 or more; copies count, though no pair of them is made), text_hash, and first: whether the row is its
class's (of several with that doc_id and different texts the one of the least hash; equal rows all are). Null and empty texts have
no links and are classes of their own. Rows that share a doc_id count as copies or links of each other by their texts. A null
doc_id takes part, and comes before all others. Columns besides doc_id and text are ignored. Without `links`, n_links is null and
only as many pairs are compared as the classes need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, map_arrow, stored, table
from .components import components
from .hashing import chunks, mix, word_shingles
from .minhash import HOT_SAMPLE, Forest, Make, connected, groups, hot_keys, members, prefix_length, shared, verified

SHINGLE, THRESHOLD, TREES, RECALL = 5, 0.8, 16, 0.999
#: How deep the first prefixes are, and by how much they are shortened at a time, down to what the recall needs at the threshold.
DEEPEST, STEP = 6, 2
_NONE = -(1 << 63)
_SIGNATURE = "id long, hash long, set1 long, set2 long, n_items long, paths array<long>"


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1).view(np.int64)))


def _distinct(shingles: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's shingles, as their upper 52 bits, sorted and without repeats."""
    low = np.uint64(12)
    out, ends, n = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for lo in range(0, len(at) - 1, 4096):  # row and shingle in one number to sort
        hi = min(lo + 4096, len(at) - 1)
        row = np.repeat(np.arange(hi - lo, dtype=np.uint64) << np.uint64(52), np.diff(at[lo : hi + 1]))
        both = np.sort(row | (shingles[at[lo] : at[hi]] >> low))
        both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        ends.append(n + np.searchsorted(both, np.arange(1, hi - lo + 1, dtype=np.uint64) << np.uint64(52)) if hi - lo < 4096 else n + np.append(np.searchsorted(both, np.arange(1, 4096, dtype=np.uint64) << np.uint64(52)), len(both)))
        n += len(both)
        out.append(both & np.uint64((1 << 52) - 1))
    return np.concatenate(out), np.concatenate(ends)


def _sets(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunk: the rows that have shingles, their sets and offsets, and two hashes of each whole set."""
    for lo, hi, data, offsets in chunks(column):
        items, at = _distinct(*word_shingles(data, offsets, size))
        rows = np.flatnonzero(np.diff(at))
        at = np.concatenate([at[rows], at[-1:]])
        if len(rows):
            yield rows + lo, items, at, np.add.reduceat(mix(items), at[:-1]), np.add.reduceat(mix(items ^ np.uint64(0x5851F42D4C957F2D)), at[:-1])


def signatures(docs: DataFrame, forest: Forest, size: int = SHINGLE) -> DataFrame:
    """docs: id, text. The texts with shingles: id, the text's hash, two hashes of the shingle set, its size, and its paths, tree by tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "hash"))
            for rows, items, at, one, two in _sets(batch.column("text"), size):
                paths = forest.paths(items, at).reshape(len(rows), -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(hashes[rows]), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.diff(at)), _lists(paths)], names=["id", "hash", "set1", "set2", "n_items", "paths"])

    return map_arrow(docs.select("id", F.xxhash64("text").alias("hash"), "text"), run, _SIGNATURE)


def classes_of_copies(found: DataFrame) -> DataFrame:
    """The copies' classes: node (a hash of the shingle set), set2, id and hash (of the first row), copies, n_items, paths."""
    first = F.min(F.struct("id", "hash")).alias("f")
    return found.groupBy("set1", "set2").agg(first, F.count(F.lit(1)).alias("copies"), F.first("n_items").alias("n_items"), F.first("paths").alias("paths")).select(F.col("set1").alias("node"), "set2", "f.id", "f.hash", "copies", "n_items", "paths")


def by_tree(distinct: DataFrame, forest: Forest) -> DataFrame:
    """p0, p1 ..., node: the paths, a row for each tree."""
    n = len(forest.depths)
    path = F.explode(F.transform(F.sequence(F.lit(0), F.lit(forest.trees - 1)), lambda t: F.slice("paths", t * n + 1, n))).alias("path")
    return distinct.select("node", path).select(*(F.col("path")[i].alias(f"p{i}") for i in range(n)), "node")


def maker(size: int = SHINGLE) -> Make:
    def make(column: pa.Array, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = []
        for rows, items, at, one, _ in _sets(column, size):
            own = one.view(np.int64) == nodes[rows]  # not another text of the same id
            parts.append((rows[own], items[np.repeat(own, np.diff(at))], np.concatenate([[0], np.cumsum(np.diff(at)[own])])))
        return joined_sets(parts)

    return make


def joined_sets(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(1, np.int64)
    rows, items, at = zip(*parts, strict=True)
    return np.concatenate(rows), np.concatenate(items), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x) for x in at]))])


def depths_for(threshold: float, trees: int, recall: float) -> tuple[int, ...]:
    """The depths of the forest: from the longest that gives the recall at the threshold up to DEEPEST."""
    least = prefix_length(threshold, trees, recall, DEEPEST)
    return tuple(sorted({*range(DEEPEST, least, -STEP), least}))


def similar(docs: DataFrame, distinct: DataFrame, forest: Forest, make: Make, links: bool) -> DataFrame:
    """a, b, links: of the distinct texts (node, id, hash, copies, n_items, paths) by the forest, from its longest prefixes to its shortest."""
    n = distinct.count()
    paths = by_tree(distinct, forest)
    hot = hot_keys(by_tree(distinct.sample(min(1.0, HOT_SAMPLE / max(1, n)), 5), forest))
    nodes_of = stored(shared(paths, hot), "shared")
    known = distinct.select("node", "id", "hash", F.col("copies").alias("weight"), "n_items")
    found: DataFrame | None = None
    names: DataFrame | None = None
    seen: DataFrame | None = None
    for round_, level in enumerate(range(len(forest.depths), 0, -1)):
        grouped = groups(nodes_of.where(F.col("level") == level).select("key", "node"), round_)
        if seen is not None:  # groups of the same nodes were compared before
            bare = lambda c: F.col(c).bitwiseAND(F.lit((1 << 58) - 1))
            grouped = grouped.join(seen.select(bare("group").alias("_g")).distinct(), bare("group") == F.col("_g"), "left_anti")
        grouped = stored(grouped, "grouped")
        seen = grouped if seen is None else seen.unionByName(grouped)
        proposed, names = members(grouped, known, links, names)
        proposed = stored(proposed, "members")
        # repeated rows that share a doc_id are sent once
        once = docs.join(bounded(proposed.select("id", "hash").distinct()), ["id", "hash"]).dropDuplicates(["id", "hash"])
        once = once if links else stored(once, "texts")  # connected() looks at them twice
        texts = once.join(bounded(proposed.drop("n_items")), ["id", "hash"])
        told = stored(verified(texts, forest.threshold, make) if links else connected(proposed, texts, forest.threshold, make), "links")
        found = told if found is None else found.unionByName(told)
    return found


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, trees: int = TREES, recall: float = RECALL, links: bool = True) -> DataFrame:
    """docs: doc_id, text. doc_id, class_id, n_links, text_hash, first."""
    forest = Forest(threshold, trees, depths_for(threshold, trees, recall))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("id"), F.xxhash64("text").alias("hash"), "text")
    found = stored(signatures(docs, forest, size), "signatures")
    distinct = stored(classes_of_copies(found), "classes")
    told = stored(similar(docs, distinct, forest, maker(size), links), "links")
    joined = components(told)
    least = joined.join(distinct.select("node", "id", "hash"), "node").groupBy("component").agg(F.min(F.struct("id", "hash")).alias("class"))
    more = joined.join(least, "component").select("node", "class").join(told.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")), "node", "left")
    counted = F.col("copies") - 1 + F.coalesce("links", F.lit(0)) if links else F.lit(None)
    of_set = distinct.join(more, "node", "left").select(F.col("node").alias("set1"), "set2", F.coalesce("class", F.struct("id", "hash")).alias("class"), counted.cast("long").alias("links"))
    of = found.select("id", "hash", "set1", "set2").join(of_set, ["set1", "set2"]).select("id", "hash", "class", "links")
    bare = docs.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select("id", "hash", F.struct("id", "hash").alias("class"), F.lit(0 if links else None).cast("long").alias("links"))
    name = lambda c: F.when(F.col(c) != _NONE, F.col(c))
    first = (F.col("id") == F.col("class.id")) & (F.col("hash") == F.col("class.hash"))
    return of.unionByName(bare).select(name("id").alias("doc_id"), name("class.id").alias("class_id"), F.col("links").alias("n_links"), F.col("hash").alias("text_hash"), first.alias("first"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")
