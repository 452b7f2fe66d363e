"""Fuzzy line dedup: one line stays of each group of lines that are near copies.

Lines stand between \\n. Their sets of six-character shingles (a shorter line is one shingle) have MinHash signatures, which are
banded for high recall; lines that share a band are verified by the exact Jaccard similarity of 0.8 or more, and joined by
distributed union-find. Of each component, copies included, the first line by (doc_id, line number) stays.

Lines of white space alone are never copies and always stay. A document that loses its last line with words is dropped; one that
never had any stays as it is. Null text has no lines and stays null. Rows that share a doc_id are one document's: each keeps its own first
line of a component that begins there. A null doc_id comes before all others. Other columns pass through (names that
begin with _line_ are the operator's own); n_chars, where there is one, is counted anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import bounded, dropped, map_arrow, nonnull, repeats, stored, table
from .components import components
from .hashing import char_shingles
from .minhash import HOT_SAMPLE, Forest, connected, groups, hot_keys, members, prefix_length, shared
from .near import _distinct, joined_sets

SHINGLE, THRESHOLD, BANDS, RECALL = 6, 0.8, 11, 0.995
#: Characters of lines that are hashed at once; a longer line is hashed by itself.
CHARS = 1 << 18
_WHITE = " \t\n\v\f\r"


def _parted(lines: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, lines) of about CHARS characters together."""
    at = 0
    while at < len(lines):
        to, n = at, 0
        while to < len(lines) and (to == at or n + len(lines[to]) <= CHARS):
            n += len(lines[to])
            to += 1
        yield at, lines[at:to]
        at = to


def node(line: str) -> int:
    """The line's hash, the same as Spark's xxhash64."""
    return (xxhash.xxh64_intdigest(line.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)


def band_keys(docs: DataFrame, forest: Forest) -> DataFrame:
    """p0 (the band's key), node: each line's bands, once for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [*{x: None for t in batch.column("text").to_pylist() for x in t.split("\n") if x.strip(_WHITE)}]
            for _, part in _parted(lines):
                keys = forest.paths(*char_shingles(part, SHINGLE))[:, :, 0].view(np.int64)
                nodes = np.array([node(x) for x in part], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(nodes, keys.shape[1]))], names=["p0", "node"])

    return map_arrow(docs.select(nonnull(F.col("text")).alias("text")), run, "p0 long, node long")


def lines_of(docs: DataFrame) -> DataFrame:
    """id, hash, at, line, node: the lines with words; the text's hash tells rows apart that share an id."""
    wordy = F.ltrim(F.col("line"), F.lit(_WHITE)) != ""
    return docs.select("id", F.xxhash64("text").alias("hash"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).where(wordy).withColumn("node", F.xxhash64("line"))


def texts_of(docs: DataFrame) -> DataFrame:
    """id, text, node: the lines with words, once for each row that has them."""
    lines = docs.select("id", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("text"))
    return lines.where(F.ltrim(F.col("text"), F.lit(_WHITE)) != "").withColumn("node", F.xxhash64("text"))


def make(column: pa.Array, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = []
    for lo, part in _parted(column.to_pylist()):
        items, at = _distinct(*char_shingles(part, SHINGLE))
        parts.append((np.arange(lo, lo + len(part)), items, at))
    return joined_sets(parts)


def line_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs: id, text. node, least, component: for the lines that occur again, exactly or nearly, the first document of their component."""
    forest = Forest(threshold, BANDS, (prefix_length(threshold, BANDS, RECALL),))
    lines = lines_of(docs)
    distinct = stored(lines.groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.max(F.length("line")).alias("n_items")), "lines")
    known = distinct.select("node", "id", F.lit(1).cast("long").alias("weight"), "n_items")
    hot = hot_keys(band_keys(docs.sample(min(1.0, HOT_SAMPLE / max(1, docs.count())), 5), forest))
    keys = stored(shared(band_keys(docs, forest), hot), "shared")
    grouped = stored(groups(keys.select("key", "node")), "grouped")
    proposed = stored(members(grouped, known, links=False)[0], "members")
    dropped(keys)
    once = texts_of(docs).join(bounded(proposed.select("node", "id").distinct()), ["node", "id"], "left_semi")
    # rows that share an id can have a line each; else nothing repeats, and the texts needn't move
    once = stored(once.dropDuplicates(["node", "id"]) if repeats(docs, "id") else once, "texts")
    texts = once.join(proposed.drop("n_items").hint("merge"), ["node", "id"])  # the same plan at every size
    joined = components(stored(connected(proposed, texts, threshold, make), "links"))
    first = joined.join(distinct, "node").groupBy("component").agg(F.min("id").alias("least"))
    near = joined.join(first, "component").select("node", "least", "component")
    return distinct.join(near, "node", "left").where("n > 1 OR least IS NOT NULL").select("node", F.coalesce("least", "id").alias("least"), F.coalesce("component", "node").alias("component"))


def copied_lines(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """id, hash, again: by text its lines that occur again: at, component, and whether the component's first document is this one."""
    again = lines_of(docs).select("id", "hash", "at", "node").join(bounded(classes), "node")
    found = again.groupBy("id", "hash").agg(F.collect_list(F.struct("at", "component", (F.col("id") == F.col("least")).alias("here"))).alias("again"))  # as long as the text
    return found


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the texts that are left, and n_lines and n_removed (lines with words)."""
    marked = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    thin = docs.where("text IS NOT NULL").select(marked.alias("id"), "text")
    gone = stored(copied_lines(thin, stored(line_classes(thin, threshold), "line-classes")), "copied-lines")
    gone = gone.select(F.col("id").alias("_line_id"), F.col("hash").alias("_line_hash"), F.col("again").alias("_line_again"))
    keyed = docs.withColumn("_line_id", marked).withColumn("_line_hash", F.xxhash64("text"))
    kept = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_removed = [], [], []
            for text, again in zip(batch.column("text").to_pylist(), batch.column("_line_again").to_pylist(), strict=True):
                lines, gone, seen = (text or "").split("\n"), set(), set()
                for x in sorted(again or (), key=lambda x: x["at"]):
                    if not x["here"] or x["component"] in seen:
                        gone.add(x["at"])
                    seen.add(x["component"])
                texts.append(text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone))
                n_lines.append(sum(bool(x.strip(_WHITE)) for x in lines))
                n_removed.append(len(gone))
            cols = [*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())]
            out = pa.RecordBatch.from_arrays(cols, names=[*kept, "text", "n_lines", "n_removed"])
            yield out.filter(pa.array([n == 0 or n > r for n, r in zip(n_lines, n_removed, strict=True)], pa.bool_()))

    schema = docs.select(*kept, "text").schema.add("n_lines", LongType()).add("n_removed", LongType())
    out = map_arrow(keyed.join(bounded(gone), ["_line_id", "_line_hash"], "left").select(*kept, "text", "_line_again"), run, schema)
    if "n_chars" in kept:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"), "text")
