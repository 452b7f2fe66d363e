import hashlib
import random
from collections import defaultdict

import pytest

from sparkloom.llm import recipes

SCHEMA = "doc_id long, text string, kept string, recipe int"


def brute(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    out = []
    for i, t in rows:
        own = by[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def texts():
    r = random.Random(1)
    long = "".join(r.choice("abcde \n") for _ in range(90_000))
    base = ["", None, "a", "a ", "é" * 700, long, long[:-1], "x" + long, long[:40_000] + "!" + long[40_000:], "z" * 50_000, "z" * 50_001, long[:20_000], long[512:20_000]]
    return [(i, base[i % len(base)]) for i in range(60)] + [(None, "a"), (None, "only null"), (None, "only null"), (7, "z" * 50_000), (59, "twice"), (59, "twice"), (59, "twice")]


@pytest.mark.parametrize("collide", [False, True])
def test_copies_against_brute_force(spark, monkeypatch, collide):
    """Also where different chunks share an identifier of the first seed."""
    if collide:
        monkeypatch.setattr(recipes, "identifier", _weak)
    rows = texts()
    docs = spark.createDataFrame([(*x, "own", 1) for x in rows], SCHEMA).repartition(3)
    got = recipes.copies(docs).collect()
    assert sorted(((x["doc_id"], x["keep_id"], x["group_size"], x["text_sha256"]) for x in got), key=str) == brute(rows)
    kept = [(x["keep_id"], x["text_sha256"]) for x in got if x["kept"]]
    assert len(kept) == len({hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}) == len(set(kept))
    assert all(x["doc_id"] == x["keep_id"] for x in got if x["kept"])
    assert got[0].asDict().keys() == {"doc_id", "recipe", "keep_id", "group_size", "kept", "text_sha256"}


def _weak(chunk, seed):
    """Two identifiers at seed 0, good ones after."""
    import xxhash

    return bytes([len(chunk) % 2]) * 16 if seed == 0 else xxhash.xxh3_128_digest(chunk, seed)


def test_dedup_keeps_whole_rows(spark):
    rows = texts()
    docs = spark.createDataFrame([(*x, f"own{k}", 1) for k, x in enumerate(rows)], SCHEMA)
    left = recipes.dedup(docs).collect()
    assert sorted((x["text"] or "" for x in left)) == sorted({t or "" for _, t in rows})
    assert left[0].asDict().keys() == {"doc_id", "text", "kept", "recipe"}
    assert recipes.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert recipes.copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chunks_follow_the_content():
    r = random.Random(2)
    data = bytes(r.randrange(256) for _ in range(400_000))
    for text in (data, b"", b"abc", b"z" * 100_000):
        cuts = recipes.cuts(text)
        assert b"".join(bytes(c) for _, c in recipes.chunks(text, 0)) == text
        assert all(b - a <= recipes.MOST for a, b in zip(cuts, cuts[1:], strict=False))
    moved = {i for i, _ in recipes.chunks(b"twelve bytes" + data, 0)}
    own = [i for i, _ in recipes.chunks(data, 0)]
    assert len(own) > 100 and len(set(own) - moved) <= 3


def test_few_chunks_move(spark):
    """A long text that a hundred rows have moves once for each task at most."""
    rows = [(i, "long text " * 20_000) for i in range(100)]
    table = recipes.chunk_table(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).select("text"))
    assert table.selectExpr("sum(length(chunk)) n").first()["n"] <= 200_000
