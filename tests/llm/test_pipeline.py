import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import bpe

from . import brute


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    import random

    r = random.Random(3)
    words = [a + b for a in "ka lo mi nu pe ra si to".split() for b in "bado figu heja keli mona".split()]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, item, shared = text(80), text(30), text(25)
    near = base.split()
    near[40] = "other"
    docs = [(i, text(60) + "\n" + text(30)) for i in range(60)] + [(100 + i, text(30) + (" vilewort" if i % 2 else "")) for i in range(60)]
    docs += [(200, base), (201, base), (202, " ".join(near)), (210, text(20) + "\n" + shared), (211, text(20) + "\n" + shared), (220, text(40) + " " + item), (230, None), (231, ""), (250, "odd one " + text(9)), (250, "odd one again " + text(9))]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100 and i % 2)) for i, _ in docs if i < 150], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_each_stage_against_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    plain = lambda rows: [(x["doc_id"], x["text"]) for x in rows]
    many = lambda rows: Counter(plain(rows))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = docs.collect(), stage(spark, docs, tables)
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = after.collect()
        assert all(x["n_chars"] == (len(x["text"]) if x["text"] is not None else None) for x in rows)
        if name == "toxicity":  # "vilewort" is all that makes a text toxic here
            assert many(rows) == Counter((i, t) for i, t in plain(before) if "vilewort" not in (t or ""))
        elif name == "line dedup":
            assert many(rows) == Counter(brute.dedup_lines(plain(before)))
        elif name == "jaccard join":
            kept, classes = many(rows), brute.keep_distinct(plain(before))
            assert all(sum(kept[x] for x in c) == 1 for c in classes) and len(rows) == len(classes)
        else:
            assert many(rows) == Counter((i, t) for i, t in plain(before) if not brute.contaminated(t, items))
        docs = spark.createDataFrame(rows, docs.schema)
    assert 220 not in {r["doc_id"] for r in rows} and len(rows) > 60
    library = Tokenizer.from_file(bpe.public_path())
    got = {x["doc_id"]: x for x in corpus_pipeline.STAGES[-1][1](spark, docs.where("doc_id <> 250"), tables).collect()}
    for x in docs.where("doc_id <> 250").collect():
        said = library.encode(x["text"] or "", add_special_tokens=False).ids
        assert list(got[x["doc_id"]]["ids"]) == said and got[x["doc_id"]]["n_tokens"] == len(said)
        assert got[x["doc_id"]]["decoded_sha256"] == hashlib.sha256(library.decode(said, skip_special_tokens=False).encode()).hexdigest()


def test_unique_texts_stay_whatever_their_ids(spark):
    """Of a text that shares its doc_id with a copy of another nothing is lost."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (None, c), (None, c), (7, c), (None, None), (8, None), (9, ""), (5, b), (6, b + " more")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, toxic string, first int")
    got = corpus_pipeline.keep_distinct(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((x["doc_id"], x["text"]) for x in got.collect()), key=str) == sorted([(1, a), (5, b), (None, c), (None, None), (8, None), (9, "")], key=str)


def test_run_and_empty_tables(spark, tables, tmp_path):
    assert corpus_pipeline.run(spark, tables).count() > 60
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
