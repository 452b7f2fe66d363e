"""Cross-tokenizer alignment by an event sweep: where do the tokens of two tokenizers end, which groups and links do they form?

Both tokenizers encode a text, A with a blank before it, B, which adds one itself, without. Every token ends at a byte offset; the
end events of both are united, partitioned by document, sorted by offset within partitions and streamed through a state machine.
Events move packed: one row for a tokenizer's ends within BLOCK bytes of a text. The machine holds the tokens that the other side
hasn't reached yet (fewer than a token's bytes) and the group that isn't closed.

Offsets where both sides end cut the tokens into groups. Between two neighbouring offsets stands one token of each side: a link. So
the links of a text are its distinct offsets, each met once, and no pairs are made. Links are added up by pair within a text
before anything is stored, within a task before anything is shuffled.

How often a pair is linked in the corpus is looked up for each text: pairs linked often are broadcast (at most HELD, by a threshold
on their count), the links of the others are joined by shuffle.

Texts that are null or empty, or that a tokenizer doesn't give back byte by byte, have no tokens: zeros and no groups. Strings of
special tokens inside texts are plain text. Rows are documents each, whatever their doc_id. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, map_arrow, nonnull, stored, table

#: Bytes of a text whose ends move in one row; characters of a text that are encoded at once.
BLOCK, PIECE = 1 << 18, 1 << 16
#: Pairs whose counts are broadcast, of 12 bytes each; links that a task adds up at once.
HELD, TOGETHER = 1_000_000, 1 << 22
A_FILE, A_RANKS, B_FILE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"

# Long texts are cut before these blanks; where one has other white space it is encoded in one.
_OTHER_WHITE = re.compile("[\x0b-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u2581\u3000\ufeff]")
# Others may be letters or numbers to one library alone, as they know other versions of Unicode; the tests compare all of these.
_UNSURE = re.compile("[^\x00-\u0233\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u04ff\u2010-\u2027\u2030-\u205e\u20a0-\u20b1\u2190-\u21ff\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")
_BOUNDARY = re.compile("(?<=[^ \t\n])[ \t\n]")


def file_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {chr(b if b in visible else next(hidden)): b for b in range(256)}


class SideA:
    """Byte-level BPE. Texts of characters that both libraries are known to class alike are encoded by the vocabulary's ranks, which is faster; others by the tokenizer file."""

    def __init__(self, path: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.of_file = Tokenizer.from_file(path)
        self.of_file.encode_special_tokens = True
        self.of_file.no_truncation()
        self.of_file.no_padding()
        read = (line.split() for line in Path(ranks).read_bytes().splitlines() if line)
        self.of_ranks = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in read}, special_tokens={})
        told = byte_level()
        self.bytes = [b""] * (max(self.of_file.get_vocab().values()) + 1)
        for token, i in self.of_file.get_vocab().items():
            self.bytes[i] = bytes(told[c] for c in token) if all(c in told for c in token) else token.encode()

    def encode(self, text: str) -> list[int]:
        if _UNSURE.search(text):
            return self.of_file.encode(text, add_special_tokens=False).ids
        return self.of_ranks.encode_ordinary(text)


class SideB:
    """Pieces with bytes as a last resort; a blank stands before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.blank = self.model.piece_to_id("▁")
        # no piece goes on over a blank, nor joins the blank that the model adds with one that isn't a space
        self.cut = not any(re.search("[^▁][▁\t\n]|[\t\n]", p) for i, p in enumerate(pieces) if not self.model.is_byte(i))

    def encode(self, text: str) -> list[int]:
        """text: begins with a blank, which the model's own stands for if it is a space."""
        if text[0] != " ":
            return self.model.encode(text)[1:]
        return self.model.encode(text[1:]) if len(text) > 1 else [self.blank]


class Encoder:
    """Both encodings of texts, as packed ids."""

    def __init__(self, a: SideA, b: SideB):
        self.sides = (a, b)

    def pieces(self, text: str) -> Iterator[str]:
        """The text cut before blanks; whole, where it may have white space that tokens go on over."""
        at = 0
        if self.sides[1].cut and (len(text) <= PIECE or not _OTHER_WHITE.search(text)):
            while cut := _BOUNDARY.search(text, at + PIECE):
                yield text[at : cut.start()]
                at = cut.start()
        yield text[at:]

    def __call__(self, text: str) -> tuple[bytes, bytes] | None:
        """The ids of `text` by A and B, each of two bytes; none if it has no tokens, as a side doesn't give it back."""
        out: tuple[list[bytes], list[bytes]] = ([], [])
        for piece in self.pieces(" " + text) if text else ():
            raw = piece.encode()
            for side, packed in zip(self.sides, out, strict=True):
                ids = side.encode(piece)
                if b"".join(map(side.bytes.__getitem__, ids)) != raw:
                    return None
                packed.append(np.array(ids, "<u2").tobytes())
        return (b"".join(out[0]), b"".join(out[1])) if text else None


@cache
def encoder(a_file: str, a_ranks: str, b_file: str) -> Encoder:
    """One for a worker."""
    import os

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are what runs side by side
    return Encoder(SideA(a_file, a_ranks, public_tokenizers.PATTERN), SideB(b_file))


def _lengths(side: SideA | SideB) -> np.ndarray:
    return np.array([len(x) for x in side.bytes], np.int64)


def events(docs: DataFrame, files: tuple[str, str, str]) -> DataFrame:
    """row, doc_id, block, side, first (the offset where the block's first token starts), ids: a head (block -1) for each row, and the ends of both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(*files)
        lengths = [_lengths(s) for s in coder.sides]
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            which, block, side, first, ids = [], [], [], [], []

            def put(*x: object, to: tuple = (which, block, side, first, ids)) -> None:
                for column, v in zip(to, x, strict=True):
                    column.append(v)

            for k, text in enumerate(batch.column("text")):
                put(k, -1, 0, 0, b"")
                for s, packed in enumerate(coder(text.as_py()) or ()):
                    own = np.frombuffer(packed, "<u2")
                    ends = np.cumsum(lengths[s][own])
                    of = (ends - 1) // BLOCK
                    starts = np.flatnonzero(np.diff(of, prepend=-1))
                    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(own)], strict=True):
                        put(k, int(of[lo]), s, int(ends[lo - 1]) if lo else 0, packer.compress(own[lo:hi].tobytes()))
            at = pa.array(which, pa.int64())
            columns = [batch.column("row").take(at), batch.column("doc_id").take(at), pa.array(block, pa.int64()), pa.array(side, pa.int8()), pa.array(first, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "block", "side", "first", "ids"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), nonnull(F.col("text")).alias("text"))
    # one pass makes the events of both sides, united, so that a row has one number
    return map_arrow(numbered, run, "row long, doc_id long, block long, side tinyint, first long, ids binary")


def swept_order(ends: DataFrame) -> DataFrame:
    return ends.repartition("row").sortWithinPartitions("row", "block", "side")


class Sweep:
    """The machine for one text: takes blocks of ends in order, gives links and closed groups as they are known."""

    def __init__(self) -> None:
        self.ends = [np.zeros(0, np.int64), np.zeros(0, np.int64)]  # of the tokens of the group that isn't closed, and later ones
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.at = 0  # links are given up to here

    def feed(self, ends: list[np.ndarray], ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """(links' ends, A ids, B ids), then by side the groups' numbers (from 0) and ids of all tokens in groups that are closed now."""
        ends = [np.concatenate(x) for x in zip(self.ends, ends, strict=True)]
        ids = [np.concatenate(x) for x in zip(self.ids, ids, strict=True)]
        known = min(x[-1] if len(x) else 0 for x in ends)
        events = np.sort(np.concatenate([e[np.searchsorted(e, self.at, "right") : np.searchsorted(e, known, "right")] for e in ends]))
        first = np.ones(len(events), bool)
        first[1:] = events[1:] != events[:-1]
        links = events[first]
        a, b = (i[np.searchsorted(e, links)] for e, i in zip(ends, ids, strict=True))
        self.at = max(self.at, int(known))
        common = np.intersect1d(*ends, assume_unique=True)
        closed = [int(np.searchsorted(e, common[-1], "right")) if len(common) else 0 for e in ends]
        groups = [np.searchsorted(common, e[:n]) for e, n in zip(ends, closed, strict=True)]
        out = [i[:n] for i, n in zip(ids, closed, strict=True)]
        self.ends, self.ids = [e[n:] for e, n in zip(ends, closed, strict=True)], [i[n:] for i, n in zip(ids, closed, strict=True)]
        return links, a, b, groups, out


def _streamed(batches: Iterator[pa.RecordBatch], lengths: list[np.ndarray]) -> Iterator[tuple]:
    """(row, doc_id, None) where a document begins, then (row, doc_id, its sweep's output, block by block)."""
    unpacker, row, doc, sweep, block = zstandard.ZstdDecompressor(), None, None, None, None
    empty = np.zeros(0, np.int64)
    held: list = [(empty, empty), (empty, empty)]

    def fed() -> tuple:
        nonlocal held
        out = sweep.feed([e for e, _ in held], [i for _, i in held])
        held = [(empty, empty), (empty, empty)]
        return row, doc, out

    for batch in batches:
        rows, docs, blocks, sides, firsts = (batch.column(c).to_pylist() for c in ("row", "doc_id", "block", "side", "first"))
        packed = batch.column("ids")
        for k, now in enumerate(rows):
            if blocks[k] != block or now != row:
                if block is not None and block >= 0:
                    yield fed()
                block = blocks[k]
            if now != row:
                row, doc, sweep = now, docs[k], Sweep()
                yield row, doc, None
            if blocks[k] >= 0:
                ids = np.frombuffer(unpacker.decompress(packed[k].as_buffer()), "<u2").astype(np.int64)
                held[sides[k]] = (firsts[k] + np.cumsum(lengths[sides[k]][ids]), ids)
    if block is not None and block >= 0:
        yield fed()


@cache
def _numbers() -> np.ndarray:
    """By separator ("", ",", "|", ";") and number up to 2^16: both as bytes, filled up with zeros."""
    plain = np.array([str(i) for i in range(1 << 16)], "S5")
    return np.stack([np.char.add(s, plain).astype("S6").view(np.uint8).reshape(-1, 6) for s in (b"", b",", b"|", b";")])


def _written(groups: list[np.ndarray], ids: list[np.ndarray], begun: bool) -> bytes:
    """`a1,a2|b1;a3|b2,b3` for closed groups; begun: whether others stand before."""
    key = np.concatenate([groups[0] * 2, groups[1] * 2 + 1])
    order = np.argsort(key, kind="stable")
    key = key[order]
    separator = np.where(key & 1, 2, 3)
    separator[1:][key[1:] == key[:-1]] = 1
    if not begun:
        separator[:1] = 0
    out = _numbers()[separator, np.concatenate(ids)[order]].reshape(-1)
    return out[out != 0].tobytes()


def swept(ends: DataFrame, lengths: list[np.ndarray]) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the links added up by pair: pairs (A id * 2^16 + B id, four bytes each), times (four bytes each)."""
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    types = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        row = doc = None
        n, sha, links, pairs, times = [0] * 4, None, [], np.zeros(0, np.uint32), np.zeros(0, np.int64)

        def added() -> None:
            """Adds up the links at hand, so that a long text's don't pile up."""
            nonlocal pairs, times, links
            if links:
                own, counts = np.unique(np.concatenate(links), return_counts=True)
                links = []
                pairs, at = np.unique(np.concatenate([pairs, own]), return_inverse=True) if len(pairs) else (own, np.arange(len(own)))
                times = np.bincount(at, np.concatenate([times, counts]) if len(times) else counts, len(pairs)).astype(np.int64)

        def told() -> None:
            added()
            done.append((row, doc, *n, sha.hexdigest() if n[2] else "", pairs.tobytes(), times.astype("<u4").tobytes()))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

        for now, its, out in _streamed(batches, lengths):
            if out is None:
                if row is not None:
                    told()
                    if len(done) >= 2000:
                        yield batch()
                        done.clear()
                row, doc, n, sha, links, pairs, times = now, its, [0] * 4, hashlib.sha256(), [], np.zeros(0, np.uint32), np.zeros(0, np.int64)
                continue
            ends, a, b, groups, ids = out
            if len(groups[0]):
                sha.update(_written(groups, ids, n[2] > 0))
                n[2] += int(groups[0][-1]) + 1
            n[0] += len(ids[0])
            n[1] += len(ids[1])
            n[3] += len(ends)
            links.append((a << 16 | b).astype(np.uint32))
            if len(links) >= 16:
                added()
        if row is not None:
            told()
        if done:
            yield batch()

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    return map_arrow(swept_order(ends), run, schema)


def pair_counts(texts: DataFrame) -> DataFrame:
    """texts: pairs, times. pair, n: how many links hold the pair, added up within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            found, at = np.unique(np.concatenate(pairs), return_inverse=True)
            out = np.zeros(len(found), np.int64)
            np.add.at(out, at, np.concatenate(times))
            return found, out

        def batch(found: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n)], names=["pair", "n"])

        pairs, times, held = [], [], 0
        for b in batches:
            for p, t in zip(b.column("pairs"), b.column("times"), strict=True):
                pairs.append(np.frombuffer(p.as_buffer(), "<u4"))
                times.append(np.frombuffer(t.as_buffer(), "<u4").astype(np.int64))
                held += len(pairs[-1])
                if held >= TOGETHER:
                    found, n = summed(pairs, times)
                    pairs, times, held = [found], [n], len(found)
                    if held >= TOGETHER // 2:
                        yield batch(found, n)
                        pairs, times, held = [], [], 0
        if held:
            yield batch(*summed(pairs, times))

    return map_arrow(texts.select("pairs", "times"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def held_pairs(counts: DataFrame, most: int = HELD) -> DataFrame:
    """The pairs that are linked most often, all of those above some count: at most `most` of them."""
    level = F.floor(F.log2("n") * 8).cast("int")
    by = sorted(((x["level"], x["pairs"]) for x in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("pairs")).collect()), reverse=True)  # at most 512 levels
    total, least = 0, None
    for at, n in by:
        if total + n > most:
            break
        total, least = total + n, at
    return counts.where(level >= least) if least is not None else counts.limit(0)


def scored(texts: DataFrame, counts: DataFrame, most: int = HELD) -> DataFrame:
    """texts (see swept) with n_best and count_sum; counts: pair, n, best (the highest n of the pair's B id)."""
    spark = texts.sparkSession
    held = held_pairs(counts, most)
    rows = held.select("pair", "n", (F.col("n") == F.col("best")).alias("best")).toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast((rows["pair"].to_numpy().astype(np.uint32), rows["n"].to_numpy(), rows["best"].to_numpy()))  # HELD rows at most
    plain = [f.name for f in texts.schema if f.name not in ("pairs", "times")]
    rest = counts.join(F.broadcast(held.select("pair")), "pair", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for b in batches:
            n_best, sums, left = [], [], []
            for p, t in zip(b.column("pairs"), b.column("times"), strict=True):
                own, times = np.frombuffer(p.as_buffer(), "<u4"), np.frombuffer(t.as_buffer(), "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(pairs, own), max(0, len(pairs) - 1))
                there = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
                at, found = at[there], times[there]
                n_best.append(int(found[best[at]].sum()))
                sums.append(int((n[at] * found).sum()))
                left.append([{"pair": int(x), "times": int(k)} for x, k in zip(own[~there], times[~there], strict=True)])
            kind = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))
            columns = [*(b.column(c) for c in plain), pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()), pa.array(left, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*plain, "n_best", "count_sum", "left"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name in plain) + ", n_best long, count_sum long, left array<struct<pair: long, times: long>>"
    first = map_arrow(texts, run, schema)
    if rest.isEmpty():
        return first.drop("left")
    first = stored(first, "aligned")
    # hot pairs are held, so no pair that is joined here is linked more often than the threshold says
    more = first.select("row", F.explode("left").alias("x")).select("row", "x.pair", "x.times").join(rest, "pair")
    more = more.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    both = first.drop("left").join(bounded(stored(more, "rare-links")), "row", "left")
    return both.withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0))).drop("_best", "_sum")


def _ready(files: tuple[str, str, str] | None) -> tuple[tuple[str, str, str], list[np.ndarray]]:
    files = files or (file_path(A_FILE), file_path(A_RANKS), file_path(B_FILE))
    return files, [_lengths(s) for s in encoder(*files).sides]


def align(docs: DataFrame, files: tuple[str, str, str] | None = None, most: int = HELD) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; one for each row. files: A's tokenizer, A's ranks, B's model."""
    files, lengths = _ready(files)
    texts = stored(swept(events(docs, files), lengths), "swept")
    counts = pair_counts(texts)
    best = counts.groupBy((F.col("pair") % (1 << 16)).alias("b")).agg(F.max("n").alias("best"))
    counts = stored(counts.withColumn("b", F.col("pair") % (1 << 16)).join(best, "b").select("pair", "n", "best"), "pair-counts")
    return scored(texts, counts, most).select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def links(docs: DataFrame, files: tuple[str, str, str] | None = None) -> DataFrame:
    """row, doc_id, offset (of bytes in blank + text, where the overlap ends), a, b: one for each link."""
    files, lengths = _ready(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, doc, out in _streamed(batches, lengths):
            if out is not None and len(out[0]):
                n = len(out[0])
                yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([doc] * n, pa.int64()), *map(pa.array, out[:3])], names=["row", "doc_id", "offset", "a", "b"])

    return map_arrow(swept_order(events(docs, files)), run, "row long, doc_id long, offset long, a long, b long")


def groups(docs: DataFrame, files: tuple[str, str, str] | None = None) -> DataFrame:
    """row, doc_id, number (from 0), a, b (arrays of ids): one for each group."""
    files, lengths = _ready(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for row, doc, out in _streamed(batches, lengths):
            if out is None:
                before = 0
            elif len(out[3][0]):
                n = int(out[3][0][-1]) + 1
                lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(g, np.arange(n + 1)).astype(np.int32)), pa.array(i)) for g, i in zip(out[3], out[4], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([doc] * n, pa.int64()), pa.array(np.arange(before, before + n)), *lists], names=["row", "doc_id", "number", "a", "b"])
                before += n

    return map_arrow(swept_order(events(docs, files)), run, "row long, doc_id long, number long, a array<long>, b array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row")
