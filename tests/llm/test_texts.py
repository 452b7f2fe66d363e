import hashlib
import random

import pytest

from sparkloom.llm import bpe, chat, decontam, fingerprint, license, substrings, toxicity

NONE = "doc_id long, text string"


# --- substrings ---------------------------------------------------------------------------------------------------------------


def cut(rows, window=50):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, i if i is not None else -1), i if i is not None else -1)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i if i is not None else -1):
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [substrings.GROUP_WORDS, 300, 0])
def test_substrings_against_brute_force(spark, monkeypatch, most):
    """Also with groups so small that prefixes are lengthened, and to the whole window."""
    monkeypatch.setattr(substrings, "GROUP_WORDS", most)
    monkeypatch.setattr(substrings, "TOGETHER", 500)
    r = random.Random(2)
    pool = [[r.choice("abcdefgh") * r.choice((1, 2)) for _ in range(90)] for _ in range(4)]
    rows = []
    for i in range(30):
        w = [str(r.randrange(1000)) for _ in range(r.choice((0, 20, 70)))]
        for _ in range(r.choice((0, 1, 2))):
            p = r.choice(pool)
            a = r.randrange(30)
            w += p[a : a + r.choice((49, 50, 51, 60))] + [str(r.randrange(9))] * r.choice((0, 2))
        rows.append((i, " \n".join(w)))
    rows += [(30, None), (31, ""), (32, rows[3][1]), (None, rows[4][1]), (33, "x " * 400), (34, "x " * 300), (35, "a b c\x0bd\x1ce"), (35, rows[5][1]), (36, "w" * 200_000)]
    got = substrings.dedup_substrings(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n_words int"))
    assert sorted(((x["doc_id"], x["n_words"], x["n_removed"], x["kept"]) for x in got.collect()), key=str) == cut(rows)
    assert substrings.dedup_substrings(spark.createDataFrame([], NONE)).count() == 0


def test_suffix_array():
    import numpy as np

    r = random.Random(3)
    rows = [[r.randrange(3) for _ in range(r.choice((4, 30)))] for _ in range(20)] + [[1] * 20]
    codes, at = np.array(sum(rows, [])), np.cumsum([0, *map(len, rows)])
    ends, starts = np.repeat(at[1:], np.diff(at)), np.arange(at[-1])
    order, common = substrings.suffix_array(codes, ends, starts, 30)
    suffix = [codes[x : ends[x]].tolist() for x in starts]
    assert [suffix[i] for i in order] == sorted(suffix)
    for a, b, n in zip(order, order[1:], common[1:], strict=False):
        assert n == next((k for k, (x, y) in enumerate(zip(suffix[a], suffix[b], strict=False)) if x != y), min(len(suffix[a]), len(suffix[b])))


# --- chat ---------------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "[SEP]", "<!", "[!", "<", "a]b", "", "<s>[INST:user]x[/INST]</s>", "é\n[?"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate((r, t) for t in nasty for r in ("user", "assistant"))] + [(2, 1, "assistant", "b"), (2, 0, "assistant", None), (2, 0, "assistant", "a"), (3, 0, None, "x"), (3, 1, "we]ird[<", "y"), (None, 0, "user", "z"), (4, 0, "system", "x" * 200_000)]
    df = spark.createDataFrame([(*x, "extra") for x in rows], "conv_id long, turn long, role string, text string, formatted string")
    done = chat.format_chats(df)
    got = {r["conv_id"]: (r["f"], [tuple(t) for t in r["turns"]], r["loss"]) for r in done.select("conv_id", chat.F.col("formatted").alias("f"), chat.read_turns(chat.F.col("formatted")).alias("turns"), chat.loss_text(chat.F.col("pieces")).alias("loss")).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((k, r or "", t or "") for c, k, r, t in rows if c == conv))
        assert got[conv][1] == [(r, t) for _, r, t in own]
        assert got[conv][2] == "".join(t for _, r, t in own if r == "assistant")
    assert got[2][0] == "<s>[INST:assistant][SEP]a[SEP]b[/INST]</s>"
    assert chat.format_chats(df.limit(0)).count() == 0


# --- BPE ----------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return bpe.Tokenizer(bpe.public_path()), Tokenizer.from_file(bpe.public_path())


def odd_texts():
    r = random.Random(4)
    letters = "abcdefghij eto’s'é²½ⅷǅ中Σς İŒ  \x1c\x85<|endoftext|>日本🎉&&&***123"
    fixed = ["", " ", "a" * 5000, "the" * 3000, "ab" * 777 + "!" * 3000, "x<|endoftext|>y<|startoftext|><|endoftext|>", "é" * 900, "it's i'll I'M WE'VE", "ΟΔΥΣΣΕΥΣ ΣΣ", "é ẛ̣"]
    return fixed + ["".join(r.choice(letters) for _ in range(r.randint(1, 80))) for _ in range(400)] + ["".join(r.choice("etaoinshr") for _ in range(3000)) for _ in range(3)]


def test_bpe_as_the_library(both, monkeypatch):
    mine, library = both
    for piece in (bpe.PIECE, 7):
        monkeypatch.setattr(bpe, "PIECE", piece)
        for text in odd_texts():
            said = library.encode(text, add_special_tokens=False).ids
            ids, d = [*mine.encode(text)], bpe.TokenDecoder(mine)
            assert list(memoryview(b"".join(ids)).cast("I")) == said
            assert "".join(map(d.feed, ids)) == library.decode(said, skip_special_tokens=False)


def test_digests_of_the_documents_as_the_library(spark, both):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in bpe.digests(docs).collect():
        said = both[1].encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(said) and r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in said)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(both[1].decode(said, skip_special_tokens=False).encode()).hexdigest()


def test_transducer_equals_merging_and_keeps_little(both):
    merges = both[0].merges
    r = random.Random(8)
    for n in (1, 2, 49, 300):
        text = "".join(r.choice("abcdesthing") for _ in range(n))
        out, t = [], bpe.Transducer(merges)
        for c in text[:-1]:
            out += t.feed(c)
        out += t.close(text[-1])
        assert [both[0].text_of[x] for x in out] == merges.encode([*text[:-1], text[-1] + merges.end])
    t, most = bpe.Transducer(merges), 0
    for c in "abcdefghi" * 3000:
        t.feed(c)
        most = max(most, len(t.last))
    assert most <= merges.lookahead + 2 * bpe.STEP + 8


def test_decoder_gives_whole_characters(both):
    d = bpe.TextDecoder(both[0])
    ids = b"".join(both[0].encode("naïve 日本 🎉 <|endoftext|>!"))
    parts = [d.feed(ids[i : i + 4]) for i in range(0, len(ids), 4)] + [d.close()]
    assert "".join(parts) == "naïve 日本 🎉 <|endoftext|>! " and "�" not in "".join(parts)


def test_bpe_columns(spark):
    df = spark.createDataFrame([(1, "Hello  World", 9), (1, "Hello  World", 9), (2, None, None)], "doc_id long, text string, ids int")
    done = bpe.encode_texts(df)
    assert done.columns == ["doc_id", "text", "ids", "decoded"]
    assert [len(r["ids"]) for r in done.orderBy("doc_id").collect()] == [2, 2, 0]
    assert [r["text"] for r in bpe.decode_texts(done.select("doc_id", "ids")).orderBy("doc_id").collect()] == ["hello world ", "hello world ", ""]
    assert bpe.encode_texts(df.limit(0)).count() == bpe.digests(df.limit(0)).count() == 0


# --- licenses -----------------------------------------------------------------------------------------------------------------


def test_licenses_and_inheritance(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [("a/LICENSE", mit), ("a/b/c/x.py", "code\n" + "w " * 40), ("a/b/y.py", apache + "\n" + "w " * 60), ("z/q.py", "nothing here"), ("top.txt", None), (None, "license talk"), ("a/b/c/x.py", "code\n" + "w " * 40), ("a/b/c/d/NOTICE", apache), ("a/b/c/d/e/f.py", "")]
    done = license.scan(spark.createDataFrame([(i, p, t, "?") for i, (p, t) in enumerate(rows)], "id int, path string, text string, license string"))
    got = {r["id"]: (r["own_license"], r["license"], r["inherited"]) for r in done.collect()}
    assert got == {0: ("MIT", "MIT", False), 1: (None, "MIT", True), 2: ("Apache-2.0", "Apache-2.0", False), 3: (None, None, False), 4: (None, None, False), 5: (None, None, False), 6: (None, "MIT", True), 7: ("Apache-2.0", "Apache-2.0", False), 8: (None, "Apache-2.0", True)}
    assert license.scan(spark.createDataFrame([], "id int, path string, text string")).count() == 0


def test_whole_texts_headers_and_spdx_lines(spark):
    texts = {n: t for n, t, _ in license.TEMPLATES if n in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC") and not t.startswith("SPDX")}  # the longest of each
    texts = {n: max((t for m, t, _ in license.TEMPLATES if m == n), key=len) for n in texts}
    wrap = lambda t, k=9: "\n".join(" * " + " ".join(t.split()[i : i + k]) for i in range(0, len(t.split()), k))
    gnu = [t for n, t, _ in license.TEMPLATES if n == "GPL-3.0"][1]
    filler = "\n\n" + "\n".join(f"line {i} of the code does thing {i * 7}" for i in range(300))
    rows = [(f"{n}/f", "Copyright (c) 2020 Someone\n\n" + wrap(t)) for n, t in texts.items()]
    rows += [("GPL-3.0/a", wrap(gnu) + filler), ("MIT/b", texts["MIT"].removeprefix("MIT License ")), ("MIT/c", "# SPDX-License-Identifier: MIT" + filler), ("GPL-2.0/d", "// SPDX-License-Identifier: GPL-2.0-only\nint x;"), ("None/e", "# SPDX-License-Identifier: Foo-9.9" + filler), ("None/g", "we kommen mit dem license plate" + filler)]
    df = spark.createDataFrame([(None if i == 0 else i, p, t, "h", "d") for i, (p, t) in enumerate(rows)], "id int, path string, text string, hash string, dir string")
    got = license.scan(df).collect()
    assert {r["path"]: r["own_license"] or "None" for r in got} == {p: p.split("/")[0] for p, _ in rows}
    assert {r["hash"] for r in got} == {"h"} and {r["dir"] for r in got} == {"d"} and all(r["score"] > 0.8 for r in got if r["own_license"])


def test_the_right_license_by_name_and_version(spark):
    """Heads and mentions, beside a table of other texts."""
    filler = "\n\n" + "\n\n".join(f"part {i} of the terms says what you may do with thing {i * 7}, and what not" for i in range(200))
    own = {
        "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007" + filler: "GPL-3.0", "GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991" + filler: "GPL-2.0", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "LGPL-3.0",
        "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999": "LGPL-2.1", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007": "AGPL-3.0",
        "This project is licensed under the MIT license - see the LICENSE file for details": "MIT", "# Project\n\nThis project is licensed under the Apache License 2.0 - see the LICENSE file for details." + filler: "Apache-2.0",
        "Distributed under GPL-3.0-or-later": "GPL-3.0", "Mozilla Public License Version 2.0\n==================================" + filler: "MPL-2.0", "Eclipse Public License - v 2.0" + filler: "EPL-2.0", "Boost Software License - Version 1.0 - August 17th, 2003" + filler: "BSL-1.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under CC BY 4.0": "CC-BY-4.0", "Released under the MIT License.": "MIT", "All rights reserved.": "Proprietary",
        "The city's license office is open on all days but the last of the month, and it is in the old town hall.": None, "She was at MIT for ten years and then went under the sea.": None, "Drivers need a license, version or not, to be released from the rule.": None,
        "The apache is a helicopter.": None, "We will boost the version of the software.": None, "x" * 300_000: None, "license " * 50_000: None, None: None, "": None,
    }
    rows = [(i, f"d{i}/f", t) for i, t in enumerate(own)] + [(100 + i, f"e/{i}", f"other text {i} of words that say a few things") for i in range(60)]
    got = {r["id"]: r["own_license"] for r in license.scan(spark.createDataFrame(rows, "id int, path string, text string")).collect()}
    assert {t and t[:60]: got[i] for i, t in enumerate(own)} == {t and t[:60]: w for t, w in own.items()}


def test_ties_between_holders_and_far_ancestors(spark):
    mit, isc = "Released under the MIT License.", "ISC License"
    rows = [("a/LICENSE", mit), ("a/COPYING", isc), ("a/b/c/d/e/f/x", "nothing"), ("a/b/LICENSE.md", isc), ("a/b/c/y", "none"), ("q/x", "none"), ("LICENSE", mit), ("r/s/t", None)]
    got = {r["path"]: r["license"] for r in license.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a/LICENSE": "MIT", "a/COPYING": "ISC", "a/b/c/d/e/f/x": "ISC", "a/b/LICENSE.md": "ISC", "a/b/c/y": "ISC", "q/x": "MIT", "LICENSE": "MIT", "r/s/t": "MIT"}


# --- fingerprints -------------------------------------------------------------------------------------------------------------


def test_fingerprints(spark):
    rows = [(1, "a\nb\n\nc d"), (2, "a\nb\n\nc d"), (3, "a\nB\n\nc d"), (4, None), (5, ""), (6, "a\nb\nc d")]
    done = fingerprint.fingerprint(spark.createDataFrame(rows, NONE + ""))
    root = {r["doc_id"]: r["root"] for r in done.collect()}
    assert root[1] == root[2] and root[4] == root[5] and len({root[i] for i in (1, 3, 4, 6)}) == 4
    old, new = (done.where(f"doc_id = {i}").selectExpr("1 AS k", "root", "section_nodes", "paragraph_nodes") for i in (1, 3))
    assert [tuple(r)[:3] for r in fingerprint.differences(old, new, "k").collect()] == [(1, 0, 1)]
    assert fingerprint.differences(old, old, "k").count() == 0


def test_likeness_comes_from_the_tree(spark):
    import re

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def nodes(t):
        out, sections = set(), []
        for section in t.split("\n\n"):
            paragraphs = []
            for p in section.split("\n"):
                own = [sha(x) for x in re.findall(fingerprint.PHRASE, p)]
                paragraphs.append(sha("".join(own)))
                out |= {*own}
            sections.append(sha("".join(paragraphs)))
            out |= {*paragraphs}
        return out | {*sections, sha("".join(sections))}

    rows = [
        ("one two three four five. six, seven\n\neight  nine?", "one two three four five! six, seven\neight  nine?"), ("a b c d e", "x y"), ("", ""), ("same", "same"), ("", "x"), ("é ü.", "é ü. ö"),
        ("x y z.\nx y z.", "x y z."), ("one. two.\nthree.", "three.\none. two."), ("a.\n\nb.", "b.\n\na."), ("w " * 9000, "w " * 9001),
    ]
    df = fingerprint.fingerprint(fingerprint.fingerprint(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string"), "a", "a"), "b", "b")
    like = fingerprint.likeness(fingerprint.F.col("a_nodes"), fingerprint.F.col("b_nodes"))
    for r in df.select("i", like.alias("x"), "a_nodes").collect():
        a, b = (nodes(t) for t in rows[r["i"]])
        assert {*r["a_nodes"]} == a and r["x"] == pytest.approx(2 * len(a & b) / (len(a) + len(b)))
        assert (r["x"] == 1.0) == (rows[r["i"]][0] == rows[r["i"]][1])


@pytest.mark.parametrize("ids", [[5], [3, 1, 2], [None, 1, 1, 9], [*range(0, 5000, 7)], [-(1 << 62), 0, 1 << 62], [7] * 90 + [*range(40)], [1 << 40, *range(60)]])
def test_neighbours(spark, ids, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 10)
    rows = [(i, f"t{k}") for k, i in enumerate(ids)]
    got = fingerprint.neighbours(spark.createDataFrame(rows, NONE), "doc_id", "text", "next").collect()
    order = sorted({x for x in ids}, key=lambda x: (x is not None, x or 0))
    after = {a: b for a, b in zip(order, order[1:] + order[:1], strict=True)}
    text = {}
    for i, t in rows:
        text.setdefault(i, set()).add(t)
    for r in got:
        assert r["next"] in text[after[r["doc_id"]]] | (text[r["doc_id"]] if len(text[r["doc_id"]]) > 1 else set())
    assert len(got) == len(rows) and sorted(r["next"] for r in got) == sorted(t for _, t in rows)
    assert fingerprint.neighbours(spark.createDataFrame([], NONE), "doc_id", "text", "next").count() == 0


# --- decontamination ----------------------------------------------------------------------------------------------------------


def judged(rows, items, n=13):
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    out = []
    for i, t in rows:
        w, hit, ids = split(t), set(), set()
        for item, text in items:
            x = split(text)
            k = min(n, len(x))
            for s in range(len(x) - k + 1) if x else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == x[s : s + k]:
                        hit.update(range(p, p + k))
                        ids |= {str(item)} if item is not None else set()
        out.append((i, len(w), len(hit), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontamination_against_brute_force(spark):
    r = random.Random(6)
    word = lambda: r.choice("the of and rare É x1 to".split()) + r.choice(["", "a", "b"])
    items = [(k, " ".join(word() for _ in range(r.choice((1, 5, 13, 14, 30))))) for k in range(12)] + [(20, None), (21, "--"), (3, "the of"), (None, "null item")]
    rows = []
    for i in range(40):
        w = [word() for _ in range(r.choice((0, 10, 60)))]
        x = (r.choice(items)[1] or "").split()
        a = r.randrange(3)
        rows.append((i, ", ".join([*w, *x[a : a + 20], *w[:3]]).upper() if i % 2 else " ".join([*w, *x, *x])))
    rows += [(90, None), (91, ""), (92, "NULL--ITEM"), (None, items[2][1]), (92, items[4][1]), (93, "pad " * 40_000 + (items[3][1] or ""))]
    df = spark.createDataFrame([(*x, 0, "w", 1, 2, 3, 4) for x in rows], "doc_id long, text string, n_hit int, words string, doc int, found int, real int, hit int")
    got = decontam.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["doc_id", "text", "words", "doc", "found", "real", "hit", "n_words", "n_hit", "items", "contaminated"]
    assert {tuple(x)[2:7] for x in got.collect()} == {("w", 1, 2, 3, 4)}
    assert sorted(((x["doc_id"], x["n_words"], x["n_hit"], [*x["items"]], x["contaminated"]) for x in got.collect()), key=str) == judged(rows, items)
    none = spark.createDataFrame([], "item_id long, text string")
    assert {x["contaminated"] for x in decontam.decontaminate(df, none).collect()} == {False}
    assert decontam.decontaminate(df.limit(0), none).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red the blue fish"), (2, "red a b c d e blue"), (3, "blue red"), (4, None)], NONE)
    items = spark.createDataFrame([(7, "red blue")], "item_id long, text string")
    assert sorted(map(tuple, decontam.phrases_within(docs, items, 4).collect())) == [(1, 7, 0), (3, 7, 0)]


# --- toxicity -----------------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_texts(spark):
    r = random.Random(1)
    calm = [a + b for a in "ka lo mi nu pe ra".split() for b in "bado figu heja keli mona".split()]
    def text(bad):
        w = [r.choice(calm) for _ in range(30)]
        for _ in range(r.choice((1, 3)) if bad else 0):
            w[r.randrange(30)] = r.choice(["rotter", "snizzab" + r.choice(calm)])
        return " ".join(w)

    rows = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(800)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "ROTTER!")], NONE)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 500] + [(3, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    chain = toxicity.fit(docs, labels)
    got = {x["doc_id"]: x for x in toxicity.score(docs.selectExpr("*", "'old' AS toxic"), chain).collect()}
    assert all(got[i]["toxic"] == bool(y) for i, _, y in rows if i >= 500)
    assert got[902]["toxic"] and not got[900]["toxic"] and not got[901]["toxic"]
    plain = lambda chain: [(x.category, x.chosen, x.coefficients.tolist(), x.share) for x in chain.links]
    assert plain(toxicity.fit(docs.repartition(7), labels.repartition(5))) == plain(chain) == plain(toxicity.fit(docs.coalesce(1), labels.coalesce(1)))
    only = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {x["p_toxic"] for x in toxicity.score(docs, only).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels.limit(0))).count() == 0


def test_later_categories_see_earlier_ones_out_of_fold(spark):
    """The second category is the first one, or a word of its own; the first is told by a word that the second's features needn't hold."""
    r = random.Random(2)
    rows = []
    for i in range(600):
        a, b = i % 4 == 0, i % 6 == 0
        w = [r.choice(["calm", "sea", "tree", "hill", "rain"]) for _ in range(12)] + ["grumblewort"] * a + ["snarkfish"] * b
        rows.append((i, " ".join(w) + f" x{i}" + " long" * 20_000 * (i == 5), int(a), None if i == 7 else int(a or b)))
    rows += [(599, rows[-1][1], *rows[-1][2:])] * 40
    docs = spark.createDataFrame([x[:2] for x in rows], NONE)
    labels = spark.createDataFrame([(x[0], *x[2:]) for x in rows[:600]], "doc_id long, insult int, toxic int")
    chain = toxicity.fit(docs, labels, categories=("insult", "toxic"))
    assert [x.category for x in chain.links] == ["insult", "toxic"] and len(chain.links[1].coefficients) == len(chain.links[1].chosen.features) + 2 + 1 + 1
    for x in toxicity.score(docs, chain).collect():
        a, b = x["doc_id"] % 4 == 0, x["doc_id"] % 6 == 0
        assert (x["p_insult"] >= 0.5) == a and x["toxic"] == (a or b)
    assert toxicity.training_rows(docs, labels, ["toxic"], 50).count() <= 50
    assert {c for c in toxicity.judgements(spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")).first()} == {1}


def test_text_digest_of_ids():
    t = bpe.tokenizer(bpe.public_path())
    assert hashlib.sha256(b"".join(t.encode("a"))).hexdigest() == hashlib.sha256((t.vocab["a</w>"]).to_bytes(4, "little")).hexdigest()


def test_common_words_beside_a_notice_weigh_little(spark):
    talk = "see project root details here about code more info our thanks"
    rows = [(i, f"x/{i}", talk) for i in range(200)] + [(200, "y/a", f"Released under the MIT License {talk}")]
    done = license.scan(spark.createDataFrame(rows, "id int, path string, text string")).where("own_license IS NOT NULL").collect()
    assert [(r["id"], r["own_license"]) for r in done] == [(200, "MIT")] and done[0]["score"] > 0.9
