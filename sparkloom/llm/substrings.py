"""Substring dedup: the repeats of WINDOW words or more between documents, by prefix-partitioned suffix trees.

A window repeats if a suffix that starts there shares its first WINDOW words with a suffix of another document: in the suffix tree,
if it ends below an internal node of that depth. The tree is built in parts:

1. Anchors. In each window the suffix whose first PREFIX words have the least hash (the leftmost of equals) is its anchor; equal
   windows have equal anchors at equal places. Neighbouring windows share an anchor; together they are its span.
2. Suffixes are split by prefixes of various lengths: windows by their anchor's first PREFIX words. Prefixes of one document alone have
   no repeat below them and end here. Equal spans are one leaf, told by its least document; the others that have it repeat it whole.
3. A prefix with leaves of more than GROUP_WORDS words is too large for a task: its windows are split anew by their own first words, as
   many of LENGTHS as it takes for a group to fit. Windows that are alike to the last length differ in nothing: they are one node,
   reduced to its least document before the shuffle.
4. Each group's subtree is built as a suffix array with the longest common prefixes of neighbours, several groups at once. Its internal
   nodes of WINDOW words or more are the maximal repeats of the group; a leaf below one repeats so much of the node's least document.

Words are compared as they are in the subtrees; spans, prefixes and windows beyond the last length by hashes (64 bits below 64, and
128). Words stand between ASCII white space. A null text has none; a text of fewer than WINDOW words has no window. A null doc_id counts
as less than all others. Rows that share a doc_id don't repeat each other. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, map_arrow, nonnull, stored, table
from .hashing import Runs, chunks, mix, ranges, words

WINDOW, PREFIX = 50, 10
#: Words of the leaves of a group at most; to how many words prefixes are lengthened (the last is the window); words of groups built together.
GROUP_WORDS, LENGTHS, TOGETHER = 200_000, (20, 35, 50), 400_000
_NONE = -(1 << 63)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def _anchors(hashes: np.ndarray, at: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, ...]:
    """For each span: text, place of its first window in the text, number of windows, hash of the anchor's prefix, hash of the span."""
    n = np.maximum(np.diff(at) - window + 1, 0)
    if not n.any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    runs = Runs(hashes, 2)
    where = np.arange(len(hashes) - prefix + 1)
    prefixes = runs(where, where + prefix)
    bits = max(24, int(len(where)).bit_length())
    low = np.uint64((1 << bits) - 1)
    chosen = _least((prefixes & ~low) | where.astype(np.uint64), window - prefix + 1) & low
    starts, text = ranges(at[:-1], n), np.repeat(np.arange(len(n)), n)
    anchor = chosen[starts].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.append(first, len(starts)))
    lo, anchor = starts[first], anchor[first]
    span = mix(runs(lo, lo + count - 1 + window) ^ mix((anchor - lo).astype(np.uint64) + np.uint64(1)))
    return text[first], lo - at[text[first]], count, prefixes[anchor].view(np.int64), span.view(np.int64)


def spans(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """docs: id, row, text. id, row, start, n, prefix, span: each anchor's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "row"))
            for lo, _, data, offsets in chunks(batch.column("text")):
                _, _, hashes, at = words(data, offsets)
                text, start, n, p, s = _anchors(hashes, at, window, prefix)
                if len(text):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[text + lo]), pa.array(rows[text + lo]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(p), pa.array(s)], names=["id", "row", "start", "n", "prefix", "span"])

    return map_arrow(docs.select("id", "row", "text"), run, "id long, row int, start int, n int, prefix long, span long")


def leaves(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """prefix, span, least (document), its row and start, n, forks, words: of the prefixes that several documents have. forks: whether there are several spans; words: of all."""
    nodes = found.groupBy("prefix", "span").agg(F.min(F.struct("id", "row", "start", "n")).alias("first"), F.max("id").alias("most"))
    above = nodes.groupBy("prefix").agg(F.min("first.id").alias("lo"), F.max("most").alias("hi"), (F.count(F.lit(1)) > 1).alias("forks"), F.sum(F.col("first.n") + window - 1).alias("words"))
    held = stored(above.where("lo < hi").select("prefix", "forks", "words"), "prefixes")  # a plain side, so that hot prefixes can be split
    return nodes.join(held, "prefix").select("prefix", "span", F.col("first.id").alias("least"), "first.row", "first.start", "first.n", "forks", "words")


_LEAF = "prefix long, span long, least long"


def _with_text(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """docs: id, row, text; asked: least, row, start, n and more. id, text, leaves: by text what is asked of it."""
    columns = [c for c in asked.columns if c not in ("least", "row")]
    by_row = asked.groupBy(F.col("least").alias("id"), "row").agg(F.collect_list(F.struct(*columns)).alias("leaves"))  # as long as the text
    return docs.join(bounded(by_row), ["id", "row"])


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], list[dict]]]:
    for i, text, asked in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), batch.column("leaves").to_pylist(), strict=True):
        yield i, text.encode().split(), asked


def leaf_texts(docs: DataFrame, asked: DataFrame, window: int = WINDOW) -> DataFrame:
    """asked: leaves with key (of the group) and offset (of start in the leaf). key, prefix, span, least, offset, n, words: their words, one blank between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(a["key"], a["prefix"], a["span"], i, a["offset"], a["n"], b" ".join(w[a["start"] : a["start"] + a["n"] - 1 + window])) for i, w, asked in _each(batch) for a in asked]
            for at in range(0, len(out), 10_000):
                cols = list(zip(*out[at : at + 10_000], strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.int32()) for c in cols[4:6]), pa.array(cols[6], pa.binary())], names=["key", "prefix", "span", "least", "offset", "n", "words"])

    columns = asked.select("least", "row", "key", "prefix", "span", "start", "offset", "n")
    return map_arrow(_with_text(docs, columns), run, f"key long, {_LEAF}, offset int, n int, words binary")


def window_prefixes(docs: DataFrame, asked: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """asked: leaves. prefix, span, least, row, start, offset, k0, k1 ..., last: by window of a leaf the hashes of its first words, for each length, and another of the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "row"))
            wanted = batch.column("leaves").to_pylist()
            for lo, hi, data, offsets in chunks(batch.column("text")):
                _, _, hashes, at = words(data, offsets)
                each = [(t, a["start"], a["n"], a["prefix"], a["span"]) for t in range(lo, hi) for a in wanted[t]]
                if not each:
                    continue
                text, start, n, prefix, span = (np.array(x, np.int64) for x in zip(*each, strict=True))
                first = np.repeat(start, n)
                text, start, prefix, span = np.repeat(text, n), ranges(start, n), np.repeat(prefix, n), np.repeat(span, n)
                begin = start + at[text - lo]
                keys = [Runs(hashes, 2)(begin, begin + x).view(np.int64) for x in lengths] + [Runs(hashes, 0)(begin, begin + lengths[-1]).view(np.int64)]
                cols = [prefix, span, ids[text], rows[text], start.astype(np.int32), (start - first).astype(np.int32), *keys]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["prefix", "span", "least", "row", "start", "offset", *(f"k{i}" for i in range(len(lengths))), "last"])

    schema = f"{_LEAF}, row int, start int, offset int, " + ", ".join(f"k{i} long" for i in range(len(lengths))) + ", last long"
    return map_arrow(_with_text(docs, asked.select("least", "row", "prefix", "span", "start", "n")), run, schema)


def suffix_array(codes: np.ndarray, ends: np.ndarray, starts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of codes at starts in order (places in starts), and the common prefix of each with the one before it; a suffix ends at its row's end.

    By doubling: ranks of 1, 2, 4 ... codes, up to `longest`.
    """
    size, rank = len(codes), np.unique(codes, return_inverse=True)[1].astype(np.int64)
    ranks, width = [rank], 1
    while width < longest:
        to = np.arange(size) + width
        inside = to < ends
        after = np.zeros(size, np.int64)
        after[inside] = rank[to[inside]] + 1
        rank = np.unique(rank * (size + 1) + after, return_inverse=True)[1].astype(np.int64)
        ranks.append(rank)
        width *= 2
    order = np.argsort(rank[starts], kind="stable")
    a, b = starts[order[:-1]], starts[order[1:]]
    common = np.zeros(len(a), np.int64)
    room = np.minimum(ends[a] - a, ends[b] - b)
    for k in range(len(ranks) - 1, -1, -1):
        fits = common + (1 << k) <= room
        same = np.zeros(len(a), bool)
        same[fits] = ranks[k][(a + common)[fits]] == ranks[k][(b + common)[fits]]
        common[same] += 1 << k
    return order, np.append(0, common)


def _subtrees(t: pa.Table, window: int) -> pa.RecordBatch | None:
    """Of whole groups of leaves: prefix, span, offset, n: the windows of each leaf that lie in a maximal repeat with a lesser document."""
    import pyarrow.compute as pc

    parts = pc.split_pattern(t.column("words").combine_chunks().cast(pa.string()), " ")
    parts = parts.combine_chunks() if isinstance(parts, pa.ChunkedArray) else parts
    at = parts.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    words_ = parts.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    key, least, n = (t.column(c).to_numpy() for c in ("key", "least", "n"))
    _, group = np.unique(key, return_inverse=True)
    length = np.diff(at)
    codes = words_ + np.repeat(group, length) * (words_.max(initial=0) + 1)  # no node spans two groups
    ends, starts, leaf = np.repeat(at[1:], length), ranges(at[:-1], n.astype(np.int64)), np.repeat(np.arange(len(n)), n)
    order, common = suffix_array(codes, ends, starts, int(length.max(initial=1)))
    deep = common >= window
    first = np.flatnonzero(~deep)  # each of the runs between is what stands below one internal node
    count = np.diff(np.append(first, len(order)))
    node = np.repeat(np.arange(len(first)), count)
    low = np.minimum.reduceat(least[leaf[order]], first)
    depth = np.minimum.reduceat(np.where(deep, common, np.iinfo(np.int64).max), first)
    hit = least[leaf[order]] > low[node]
    if not hit.any():
        return None
    begin = starts[order][hit]
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + depth[node][hit] - window + 1, -1)
    on = np.cumsum(cover[:-1]) > 0
    row = np.repeat(np.arange(len(n)), length)
    edge = np.flatnonzero(on & np.concatenate([[True], ~on[:-1] | (row[1:] != row[:-1])]))
    stop = np.flatnonzero(on & np.concatenate([~on[1:] | (row[1:] != row[:-1]), [True]])) + 1
    at_row = row[edge]
    cols = [t.column("prefix").to_numpy()[at_row], t.column("span").to_numpy()[at_row], (t.column("offset").to_numpy()[at_row] + edge - at[at_row]).astype(np.int32), (stop - edge).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["prefix", "span", "offset", "n"])


def subtrees(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """texts: leaf_texts. prefix, span, offset, n: what of each leaf repeats a lesser document of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            key, length = batch.column("key").to_numpy(), np.array([len(x) for x in batch.column("words").to_pylist()], np.int64) // 4
            while len(batch):
                # at the end of a group, when enough is held
                cut = np.flatnonzero(np.append(True if not held else key[0] != last, key[1:] != key[:-1]) & (size + np.cumsum(length) - length >= TOGETHER))
                to = int(cut[0]) if len(cut) else len(batch)
                held.append(batch.slice(0, to))
                size += int(length[:to].sum())
                last = key[to - 1] if to else last
                if len(cut):
                    out = _subtrees(pa.Table.from_batches([x for x in held if len(x)]), window)
                    held, size = [], 0
                    if out is not None:
                        yield out
                batch, key, length = batch.slice(to), key[to:], length[to:]
        held = [x for x in held if len(x)]
        if held and (out := _subtrees(pa.Table.from_batches(held), window)) is not None:
            yield out

    return map_arrow(texts.repartition("key").sortWithinPartitions("key"), run, "prefix long, span long, offset int, n int")


def repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """docs: id, row, text. id, row, spans: array<struct<start, n>>: runs of windows that start in a lesser document too."""
    found = stored(spans(docs, window, prefix), "suffixes")
    leaf = stored(leaves(found, window), "leaves")
    forks = leaf.where("forks")
    small = forks.where(F.col("words") <= GROUP_WORDS).withColumn("key", F.col("prefix")).withColumn("offset", F.lit(0))
    marks = subtrees(leaf_texts(docs, small, window), window)
    large = stored(forks.where(F.col("words") > GROUP_WORDS), "large")
    if not large.isEmpty():
        marks = marks.unionByName(_lengthened(docs, large, window))
    marks = stored(marks, "repeats")
    whole = found.join(leaf.select("prefix", "span", "least"), ["prefix", "span"]).where("id > least").select("id", "row", "start", "n")
    first = found.join(leaf.where("forks").select("prefix", "span", F.col("least").alias("id")), ["prefix", "span", "id"])
    part = first.select("prefix", "span", "id", "row", "start").join(marks, ["prefix", "span"]).select("id", "row", (F.col("start") + F.col("offset")).alias("start"), "n")
    return whole.unionByName(part).groupBy("id", "row").agg(F.collect_list(F.struct("start", "n")).alias("spans"))  # as long as the text


def _lengthened(docs: DataFrame, large: DataFrame, window: int) -> DataFrame:
    """What of the leaves of large groups repeats a lesser document, by the windows' own prefixes."""
    lengths = (*(x for x in LENGTHS if x < window), window)
    left = stored(window_prefixes(docs, large, lengths), "windows")
    out, last = None, len(lengths) - 1
    for i in range(last):
        # a prefix of one leaf has no node below it, one of too many is lengthened
        count = left.groupBy(f"k{i}").agg(F.count(F.lit(1)).alias("_n"), F.min("least").alias("_lo"), F.max("least").alias("_hi"))
        known = stored(count.where("_lo < _hi").select(f"k{i}", (F.col("_n") * window <= GROUP_WORDS).alias("_fits")), "lengths")
        left = stored(left.join(known, f"k{i}"), "windows")
        fits = left.where("_fits").withColumn("key", F.col(f"k{i}")).withColumn("n", F.lit(1))
        marks = subtrees(leaf_texts(docs, fits, window), window)
        out = marks if out is None else out.unionByName(marks)
        left = left.where("NOT _fits").drop("_fits")
    low = stored(left.groupBy(f"k{last}", "last").agg(F.min("least").alias("_lo"), F.max("least").alias("_hi")).where("_lo < _hi").drop("_hi"), "nodes")
    same = left.join(low, [f"k{last}", "last"]).where("least > _lo").select("prefix", "span", "offset", F.lit(1).alias("n"))
    return same if out is None else out.unionByName(same)


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("id"), F.hash("text").alias("row"), nonnull(F.col("text")).alias("text"))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """docs: doc_id, text. doc_id, n_words, n_removed, kept (the words left, one blank between) and removed (word spans, from and to)."""
    marked = _marked(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, asked in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                parts, ends = text.encode().split(), []
                for s in sorted((x["start"], x["start"] + x["n"] - 1 + window) for x in asked or ()):
                    if ends and s[0] <= ends[-1][1]:
                        ends[-1][1] = max(ends[-1][1], s[1])
                    else:
                        ends.append([*s])
                n = len(parts)
                for a, b in reversed(ends):
                    del parts[a:b]
                out.append((n, n - len(parts), b" ".join(parts).decode(), [{"from": a, "to": b} for a, b in ends]))
            n, gone, kept, removed = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(removed, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))], names=["id", "n_words", "n_removed", "kept", "removed"])

    joined = marked.join(repeats(marked, window, prefix), ["id", "row"], "left").select("id", "text", "spans")
    done = map_arrow(joined, run, "id long, n_words long, n_removed long, kept string, removed array<struct<from: int, to: int>>")
    return done.select(F.when(F.col("id") != _NONE, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept", "removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT r, doc_id, s, array_to_string(w[s:s + {WINDOW - 1}], ' ') AS p FROM (SELECT *, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM d WHERE len(w) >= {WINDOW})),
m AS (SELECT p, min(doc_id) AS lo FROM v GROUP BY p),
g AS (SELECT DISTINCT r, unnest(range(s, s + {WINDOW})) AS k FROM v JOIN m USING (p) WHERE doc_id > lo),
e AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d),
k AS (SELECT e.r, string_agg(x, ' ' ORDER BY e.k) AS t, count(*) AS n FROM e LEFT JOIN g ON e.r = g.r AND e.k = g.k WHERE g.r IS NULL GROUP BY e.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
