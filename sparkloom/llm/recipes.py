"""Exact dedup by content-defined chunk recipes: of equal texts one row stays.

A text is cut into chunks where its content says so: after a byte at which the hash of the last WINDOW bytes ends in zeros, in
chunks of at least LEAST and at most MOST bytes. So texts are cut where they stand, without reading any other, and equal texts alike. A chunk's
identifier is its 128-bit hash, a text's recipe the ordered list of its chunks' identifiers, about a hundredth of the text.

Texts move as little as can be. Recipes alone are grouped: a text whose recipe is its own has no equal. Of the others the chunks are
deduplicated, within tasks first, and verified: every identifier must stand for the same bytes wherever it occurs. Should two chunks
share an identifier, all is done again with identifiers of another seed. Then equal recipes are equal texts, and ordered identifier
lists are compared in place of texts.

Null text counts as empty. Of equal texts the row of the largest doc_id stays, one without a doc_id only if none has one; of several
rows of that doc_id and text, one. An empty table gives no rows. Columns besides doc_id and text pass through `copies` and `dedup`,
whatever their names; columns that share a result's name are replaced in `copies`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, dropped, map_arrow, nonnull, stored, table

#: Bytes that decide on a cut, zero bits that make one (one in 2^BITS places), and the least and most bytes of a chunk.
WINDOW, BITS, LEAST, MOST = 16, 11, 512, 16384
#: Seeds of identifiers that are tried.
SEEDS = 8
#: Bytes of a text that are searched for cuts at once.
_STEP = 1 << 18
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def places(data: bytes) -> Iterator[int]:
    """The places in `data` where its content asks for a cut, in order."""
    for at in range(0, len(data) - WINDOW + 1, _STEP):
        part = np.frombuffer(data, np.uint8, min(_STEP + WINDOW - 1, len(data) - at), at)
        n = len(part) - WINDOW + 1
        halves = (np.ndarray(n, "<u8", part, offset, (1,)) for offset in (0, 8))  # the eight bytes from each place on
        mixed = sum((h * odd for h, odd in zip(halves, _ODD, strict=True)), np.uint64(0))
        yield from (np.flatnonzero(mixed >> np.uint64(64 - BITS) == 0) + (at + WINDOW)).tolist()


def cuts(data: bytes) -> list[int]:
    """Where chunks begin and end: 0, ..., len(data); an empty text is one empty chunk."""
    out = [0]
    for place in (*places(data), len(data)) if len(data) > LEAST else (len(data),):
        while place - out[-1] > MOST:
            out.append(out[-1] + MOST)
        if place - out[-1] >= LEAST:
            out.append(place)
    if out[-1] != len(data) or len(out) == 1:
        out.append(len(data))
    return out


def identifier(chunk: memoryview | bytes, seed: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk, seed)


def chunks(data: bytes, seed: int) -> Iterator[tuple[bytes, memoryview]]:
    """(identifier, bytes) of the chunks, in order."""
    whole = memoryview(data)
    for a, b in pairwise(cuts(data)):
        yield identifier(whole[a:b], seed), whole[a:b]


def recipes(docs: DataFrame, seed: int = 0) -> DataFrame:
    """docs' columns but text, and text_sha256 and recipe (the identifiers one after the other)."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, lists = [], []
            for text in batch.column("text"):
                data = text.as_buffer().to_pybytes()
                shas.append(hashlib.sha256(data).hexdigest())
                lists.append(b"".join(i for i, _ in chunks(data, seed)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(shas), pa.array(lists, pa.binary())], names=[*kept, "text_sha256", "recipe"])

    schema = docs.select(*kept).schema.add("text_sha256", "string").add("recipe", "binary")
    return map_arrow(docs.withColumn("text", nonnull(F.col("text"))).select(*kept, "text"), run, schema)


def chunk_table(texts: DataFrame, seed: int = 0) -> DataFrame:
    """texts: text. identifier, chunk: each pair once, deduplicated in batches and tasks before it moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            for text in dict.fromkeys(batch.column("text").to_pylist()):
                data = text.encode()
                found.update(((i, bytes(c)), None) for i, c in chunks(data, seed))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.binary()), pa.array([c for _, c in found], pa.binary())], names=["identifier", "chunk"])

    return map_arrow(texts.select(nonnull(F.col("text")).alias("text")), run, "identifier binary, chunk binary").distinct()


def verified(docs: DataFrame, suspects: DataFrame, seed: int) -> bool:
    """Whether each identifier of the texts whose xxhash64 is among `suspects` (hash) stands for the same bytes everywhere."""
    some = docs.select("text", F.xxhash64(nonnull(F.col("text"))).alias("hash")).join(bounded(suspects), "hash", "left_semi")
    return chunk_table(some, seed).groupBy("identifier").count().where("count > 1").isEmpty()


def _marked(docs: DataFrame) -> DataFrame:
    """docs with private names: _id, text, and the columns that pass through as _own_0, _own_1, ..."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select(F.col("doc_id").alias("_id"), *(F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(others)), "text")


def copies(docs: DataFrame) -> DataFrame:
    """One row for each row: docs' columns but text, keep_id, group_size, kept, text_sha256."""
    results = ("keep_id", "group_size", "kept", "text_sha256")
    own = _marked(docs)
    for seed in range(SEEDS):
        thin = own.withColumn("_hash", F.xxhash64(nonnull(F.col("text"))))
        # numbered before they are written, so that the numbers hold whoever reads them
        rows = stored(recipes(thin, seed).withColumn("_row", F.monotonically_increasing_id()), "recipes")
        by = stored(rows.groupBy("recipe", "_hash").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("_id", "_row")).alias("last")), "recipe-texts")
        groups = by.groupBy("recipe").agg(F.sum("n").alias("group_size"), F.max("last").alias("last")).where("group_size > 1")
        groups = stored(groups, "recipe-groups")
        suspects = stored(by.join(bounded(groups.select("recipe")), "recipe", "left_semi").select(F.col("_hash").alias("hash")).distinct(), "suspects")
        alone = verified(own, suspects, seed)
        for t in (by, suspects):
            dropped(t)
        if alone:
            break
    else:
        raise RuntimeError(f"no identifiers without collisions in {SEEDS} seeds")
    # a group's row is joined to many rows: where groups can't be broadcast, Spark splits the partitions of hot ones
    joined = rows.join(bounded(groups), "recipe", "left")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    passed = [F.col(f"_own_{i}").alias(c) for i, c in enumerate(others) if c not in results]
    return joined.select(
        F.col("_id").alias("doc_id"), *passed, F.when(F.col("last").isNull(), F.col("_id")).otherwise(F.col("last._id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("last._row") == F.col("_row"), F.lit(True)).alias("kept"), "text_sha256",
    )


def dedup(docs: DataFrame) -> DataFrame:
    """docs without the copies: its columns, whole. Only ids and digests of the rows that go are joined; of rows equal in both, one stays."""
    marks = stored(copies(docs.select("doc_id", "text")), "marks")
    some = marks.where("group_size > 1").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("_n"), F.bool_or("kept").alias("_stays"))
    gone = stored(some.where("NOT _stays OR _n > 1").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "_n", "_stays"), "gone")
    sha = F.sha2(nonnull(docs["text"]), 256)
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (sha == F.col("_sha"))
    left = docs.join(bounded(gone), same, "left_anti")
    again = gone.where("_stays")
    if again.isEmpty():
        return left
    one = docs.join(bounded(again), same, "left_semi").withColumn("_sha", sha).dropDuplicates(["doc_id", "_sha"]).drop("_sha")
    return left.unionByName(one)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
