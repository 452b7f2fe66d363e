import base64
import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sparkloom.llm import align

A = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
RANKS = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}


def encoded(text):
    """[(id, start, end)] of A and B by the libraries; none if a side doesn't give the text back."""
    if not text:
        return None
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    parts = [RANKS[i] for i in a], [bytes([int(B.id_to_piece(i)[3:-1], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    out = []
    for ids, x in zip((a, b), parts, strict=True):
        if b"".join(x) != (" " + text).encode():
            return None
        at, own = 0, []
        for i, t in zip(ids, x, strict=True):
            own.append((i, at, at + len(t)))
            at += len(t)
        out.append(own)
    return out


def brute(rows):
    told = [(d, encoded(t)) for d, t in rows]
    links = [[(a, b) for a, s, e in x[0] for b, p, q in x[1] if s < q and p < e] if x else [] for _, x in told]
    count = Counter(p for own in links for p in own)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (d, x), own in zip(told, links, strict=True):
        if not x:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        common = sorted({e for _, _, e in x[0]} & {e for _, _, e in x[1]})
        text = ";".join("|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in x) for lo, hi in zip([0, *common], common, strict=False))
        out.append((d, len(x[0]), len(x[1]), len(common), len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def texts():
    r = random.Random(4)
    chars = "ab eth, \n\t\r  é ﬁ日本語 한글\U0001f600́x\x00\x1c▁ '1980.​{}"
    odd = ["".join(r.choice(chars) for _ in range(r.choice((1, 3, 30, 200)))) for _ in range(60)]
    plain = ["the quick brown fox's  tail\n\n  jumps ", " ", "  ", "\n", "a", "<|endoftext|> <s>x</s> <unk> <0x0A>", "=" * 300, "ab" * 500, "naïve façade œuvre", "it's 'll don't\t\tx\n y", "a▁b", None, "", "日" * 50]
    return odd + plain


def got(df):
    names = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return sorted((tuple(x[c] for c in names) for x in df.collect()), key=str)


@pytest.mark.parametrize(("most", "block", "piece"), [(align.HELD, align.BLOCK, align.PIECE), (40, 7, 5), (0, 64, 20)])
def test_alignment_against_brute_force(spark, monkeypatch, most, block, piece):
    """Also with blocks shorter than a token, few or no pairs broadcast, and pieces of a few characters."""
    monkeypatch.setattr(align, "BLOCK", block)
    monkeypatch.setattr(align, "PIECE", piece)
    monkeypatch.setattr(align, "TOGETHER", 50 if most != align.HELD else align.TOGETHER)
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "the quick"), (3, "the quick"), (3, "the quick"), (None, None)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n_a int").repartition(3)
    assert got(align.align(docs, most=most)) == brute(rows)


def test_links_and_groups_are_those_of_the_texts(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links = Counter((x["doc_id"], x["a"], x["b"]) for x in align.links(docs).collect())
    want = Counter((d, a, b) for d, t in rows for x in [encoded(t)] if x for a, s, e in x[0] for b, p, q in x[1] if s < q and p < e)
    assert links == want
    for d, found in ((d, encoded(t)) for d, t in rows):
        own = sorted((x["number"], x["a"], x["b"]) for x in align.groups(docs.where(f"doc_id = {d}")).collect()) if d in (3, 60, 66) else None
        if own is not None and found:
            assert [i for _, a, _ in own for i in a] == [i for i, _, _ in found[0]]
            assert [i for _, _, b in own for i in b] == [i for i, _, _ in found[1]]


def test_a_very_long_text_and_an_empty_table(spark):
    long = " ".join(f"word{i % 97}ing" for i in range(60_000)) + "x" * 30_000
    docs = spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string")
    x, y = encoded(long)
    one = {r["doc_id"]: r for r in align.align(docs).collect()}[1]
    assert (one["n_a"], one["n_b"]) == (len(x), len(y))
    assert one["n_links"] == len({e for _, _, e in x} | {e for _, _, e in y})
    assert align.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ranks_are_as_the_file():
    """For all characters whose texts the ranks encode, beside letters, digits, blanks and themselves."""
    side = align.SideA(P.path(align.A_FILE), P.path(align.A_RANKS), P.PATTERN)
    known = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not align._UNSURE.search(chr(c))]
    assert len(known) > 30_000
    for at in range(0, len(known), 500):
        text = "".join(f" a{c}1{c}{c} {c}!{c} \n" for c in known[at : at + 500])
        assert side.encode(text) == A.encode(text, add_special_tokens=False).ids
    r = random.Random(5)
    for _ in range(400):
        text = " " + "".join(r.choice(r.choice((known, known[:128], known[32:34]))) for _ in range(60))
        assert side.encode(text) == A.encode(text, add_special_tokens=False).ids
