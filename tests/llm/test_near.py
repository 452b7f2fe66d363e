import random
from collections import Counter
from itertools import combinations

import pytest

from sparkloom.llm import components, lines, minhash, near

WORDS = [a + b for a in "ka lo mi nu pe ra si to vu".split() for b in "ba do fi gu he ja ke li mo".split()]


def texts(seed=3):
    r = random.Random(seed)
    out = []
    for _ in range(12):
        base = [r.choice(WORDS) for _ in range(r.choice((3, 40, 90, 200)))]
        out += [" ".join(base)] * r.choice((1, 1, 3))
        for _ in range(r.choice((0, 2, 9))):
            own = list(base)
            for _ in range(r.choice((1, 1, 3))):
                own[r.randrange(len(own))] = r.choice(WORDS)
            out.append(" ".join(own))
    return out


def truth(sets, threshold=0.8):
    """By brute force: the least index connected with each, and the number of links."""
    up, links = list(range(len(sets))), Counter()

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            a, b = top(i), top(j)
            up[max(a, b)] = min(a, b)
    return [(top(i), links[i]) for i in range(len(sets))]


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_join_against_brute_force(spark):
    t = [*texts(), None, "", " \n", "two words", "two words", "two  words", "x " * 30_000]
    got = near.jaccard_classes(spark.createDataFrame([(i, x, "a") for i, x in enumerate(t)], "doc_id long, text string, class_id string"))
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got.collect()} == dict(enumerate(truth([shingles(x) for x in t])))


def near_copies(n, seed=5, length=120, edits=1):
    r = random.Random(seed)
    base = [r.choice(WORDS) for _ in range(length)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(edits):
            own[r.randrange(length)] = r.choice(WORDS)
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("edits", "hot", "links"), [(1, True, True), (2, False, False), (2, True, False)])
def test_large_group_of_near_copies_in_blocks(spark, monkeypatch, edits, hot, links):
    """With two edits about half of the pairs are links, so classes need more than the hubs."""
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 16)
    if hot:
        monkeypatch.setattr(minhash, "HOT_TEXTS", 3)
    t = [*near_copies(90, edits=edits), *near_copies(5, seed=6), *texts()]
    got = near.jaccard_classes(spark.createDataFrame([*enumerate(t)], "doc_id long, text string"), links=links).collect()
    said = dict(enumerate(truth([shingles(x) for x in t])))
    assert {x["doc_id"]: x["class_id"] for x in got} == {i: c for i, (c, _) in said.items()}
    assert {x["doc_id"]: x["n_links"] for x in got} == ({i: n for i, (_, n) in said.items()} if links else dict.fromkeys(said))
    assert {x["doc_id"] for x in got if x["first"]} >= {c for c, _ in said.values()}


def test_null_and_repeated_ids_and_empty_tables(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, None)]
    got = near.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()), key=str) == sorted([(None, None, 2), (7, None, 2), (7, None, 2), (8, 8, 0)], key=str)
    assert near.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefixes_shorten_until_recall():
    assert minhash.prefix_length(0.8, 16, 0.999) == 4 and minhash.prefix_length(0.8, 1, 0.5) == 3 and minhash.prefix_length(0.1, 1, 0.99) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 200)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def line_truth(rows):
    lines_ = [(i, k, x) for i, t in rows if t is not None for k, x in enumerate(t.split("\n")) if x.strip()]
    kept = {(lines_[n][0], lines_[n][1]) for n in {c for c, _ in truth([{x[i : i + 6] for i in range(max(1, len(x) - 5))} for _, _, x in lines_])}}
    out = {}
    for i, t in rows:
        if t is None:
            out[i] = None
            continue
        left = [x for k, x in enumerate(t.split("\n")) if not x.strip() or (i, k) in kept]
        if any(x.strip() for x in left) or not t.strip():
            out[i] = "\n".join(left)
    return out


def test_lines_against_brute_force(spark):
    r = random.Random(9)
    pool = []
    for _ in range(25):
        base = [r.choice(WORDS) for _ in range(r.choice((1, 12, 60)))]
        pool.append(" ".join(base))
        own = list(base)
        own[0] = r.choice(WORDS)
        pool.append(" ".join(own))
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.choice((1, 4))))) for i in range(40)] + [(40, None), (41, ""), (42, " \n\t"), (43, "é" * 50_000), (44, pool[0] + "\n\n" + pool[0] + "\nonly here, said once")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, again string, n_chars long")
    got = lines.dedup_lines(df)
    assert {*got.columns} == {"doc_id", "text", "again", "n_chars", "n_lines", "n_removed"}
    told = got.collect()
    assert {x["doc_id"]: x["text"] for x in told} == line_truth(rows)
    assert all(x["n_chars"] == (None if x["text"] is None else len(x["text"])) for x in told)
    assert lines.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [[], [3], [3, 103]])
def test_shared_paths_across_batches(spark, hot):
    """A trie of two levels: 12 nodes at the top, their children named by 100 and more."""
    r = random.Random(4)
    rows = [(k, 100 + k + 50 * r.randrange(2), n) for k in range(12) for n in range(k % 4 if k != 3 else 40)] + [(3, 103, 0), (3, 103, 0)]
    keys = spark.createDataFrame([(k,) for k in hot], "key long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = minhash.shared(spark.createDataFrame(rows, "p0 long, p1 long, node long"), keys).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    said = set()
    for level in (1, 2):
        by = {}
        for x in rows:
            by.setdefault(x[:level], set()).add(x[-1])
        said |= {(level, k[-1], n) for k, v in by.items() if len(v) > 1 for n in v}
    assert {tuple(x) for x in got} == said


def test_recall_of_the_candidates_at_the_threshold(spark):
    """Pairs of 0.8 to 0.84: at least 0.95 of them are found, by both operators' parameters."""
    r, sets = random.Random(11), []
    while len(sets) < 400:
        n = r.choice((18, 45, 90, 270))
        both = -(-8 * n // 10)
        a, rest = {r.randrange(1 << 63) for _ in range(both)}, [r.randrange(1 << 63) for _ in range(n - both)]
        cut_ = r.randrange(len(rest) + 1)
        sets.append((sorted(a | {*rest[:cut_]}), sorted(a | {*rest[cut_:]})))
    import numpy as np

    for forest in (minhash.Forest(0.8, lines.BANDS, (minhash.prefix_length(0.8, lines.BANDS, lines.RECALL),)), minhash.Forest(0.8, near.TREES, near.depths_for(0.8, near.TREES, near.RECALL))):
        paths = [forest.paths(np.array(sum(side, []), np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in side])])) for side in map(list, zip(*sets, strict=True))]
        assert (paths[0][:, :, 0] == paths[1][:, :, 0]).any(1).mean() >= 0.98


def at_the_threshold(n, seed=3):
    """Pairs of texts of a Jaccard similarity of just over 0.8."""
    r, out = random.Random(seed), []
    for k in range(n):
        base = [f"w{k}x{i}x{r.randrange(1000)}" for i in range(94)]
        other = list(base)
        for place in (20, 70):  # each edit changes five of the 90 shingles
            other[place] += "edited"
        out += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    return out


@pytest.mark.parametrize("links", [True, False])
def test_the_search_finds_pairs_at_the_threshold_whatever_else_is_there(spark, links):
    """The whole search, beside many near copies of one text that share it."""
    pairs = at_the_threshold(200)
    words = lambda t: {tuple(t.split()[i : i + 5]) for i in range(90)}
    assert all(0.8 <= len(words(a) & words(b)) / len(words(a) | words(b)) < 0.81 for (_, a), (_, b) in zip(pairs[::2], pairs[1::2], strict=True))
    base = [f"c{i}" for i in range(400)]
    crowd = [(1000 + k, " ".join([*base[: k % 397], f"own{k}", *base[k % 397 + 1 :]])) for k in range(1400)]
    got = near.jaccard_classes(spark.createDataFrame(pairs + crowd, "doc_id long, text string"), links=links).where("doc_id < 1000").collect()
    assert sum(x["class_id"] == x["doc_id"] // 2 * 2 for x in got) == 400
    if links:
        assert all(x["n_links"] == 1 for x in got)


def test_prefixes_are_as_long_as_the_recall_allows():
    assert near.depths_for(0.8, near.TREES, near.RECALL) == (4, 6)
    assert near.depths_for(0.95, near.TREES, near.RECALL) == (6,)
    for t in (0.5, 0.7, 0.8, 0.9):
        assert minhash.chance(t, min(near.depths_for(t, near.TREES, near.RECALL)), near.TREES) >= near.RECALL


@pytest.mark.parametrize("size", [1, 5])
def test_word_hashes_tell_words_apart(size):
    import pyarrow as pa

    from sparkloom.llm import hashing

    column = pa.array(["a b c", None, "", "c\tb  a", "a b c", "ab c"])
    (lo, hi, data, offsets), *_ = hashing.chunks(column)
    hashes, at = hashing.word_shingles(data, offsets, size)
    sets = [tuple(hashes[x:y].tolist()) for x, y in zip(at, at[1:], strict=False)]
    assert (lo, hi) == (0, 6) and sets[0] == sets[4] != sets[3] and sets[1] == sets[2] == () and sets[5] not in sets[:5]


def test_line_with_one_edited_word_is_a_near_copy(spark):
    base = ["abcdef", *WORDS[5:27], "last"]
    one, other = (" ".join([*base[:10], word, *base[11:]]) for word in ("ghijkl", "zyxwvu"))
    of = lambda x: {x[i : i + 6] for i in range(len(x) - 5)}
    assert len(one) == len(other) and len(of(one) & of(other)) / len(of(one) | of(other)) == pytest.approx(104 / 126, abs=0.005)
    got = lines.dedup_lines(spark.createDataFrame([(1, one), (2, other + "\nsaid once only")], "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: one, 2: "said once only"}


def test_repeated_line_is_compared_once(spark, monkeypatch):
    base = WORDS[:30]
    one, other = " ".join(base), " ".join([*base[:10], "other", *base[11:]])
    sent = []

    def counted(proposed, texts, *more):
        sent.append(texts.groupBy("group", "node").count().agg({"count": "max"}).first()[0])
        return minhash.connected(proposed, texts, *more)

    monkeypatch.setattr(lines, "connected", counted)
    got = lines.dedup_lines(spark.createDataFrame([(1, "\n".join([one] * 500)), (1, one + "\nmore"), (2, other + "\nsaid once only")], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, one), (1, one + "\nmore"), (2, "said once only")]
    assert sent == [1]


def test_links_of_repeated_rows_that_share_an_id(spark):
    base = WORDS[:60]
    one, other = " ".join(base), " ".join([*base[:-1], "other"])
    rows = [(7, one), (7, one), (7, one.replace(" ", "  ")), (8, other)]
    got = near.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()) == [(7, 7, 3)] * 3 + [(8, 7, 3)]


def test_shared_keys_of_one_level_across_batches(spark):
    r = random.Random(5)
    rows = [(k, n) for k in range(40) for n in r.choices(range(6), k=k % 7)]
    r.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        found = minhash.shared(spark.createDataFrame(rows, "p0 long, node long"), spark.createDataFrame([], "key long"))
        assert "Sort [p0#" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "ASC NULLS FIRST, node#" not in plan  # one number, in linear time
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    by = {}
    for k, n in rows:
        by.setdefault(k, set()).add(n)
    assert sorted(tuple(x) for x in got) == sorted((1, k, n) for k, v in by.items() if len(v) > 1 for n in v)
