"""Texts are made and cut by many tasks, and told once."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.operators import ahead, extract, report
from sparkloom.plans import adapters, source_queries

HERE = "/root/testdata/sf0.001"


def test_texts_are_made_by_many_tasks(spark, tmp_path, monkeypatch):
    spark.range(1000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(adapters, "DEALT", 100)
    files = adapters.sources(spark, str(tmp_path))
    sizes = [r["count"] for r in files.groupBy(F.spark_partition_id()).count().collect()]
    assert files.rdd.getNumPartitions() == 10 and sum(sizes) == 1000 and max(sizes) < 200
    assert [len(r) for r in (files.where("file_id = 'p:7'").collect(), files.select("file_id").distinct().collect())] == [1, 1000]


def test_facts_are_made_once(spark):
    plan = source_queries.extract_hooks(spark, HERE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(regexp_extract_all(") == 2  # of short and of long texts


def test_texts_with_the_sign_that_ends_pieces_tell_the_same(spark):
    said = "import {{ a }} from './m{0}';\nexport const B = () => useIt('x{0}', 1);\n// {0}\n"
    files = spark.createDataFrame([("plain", "a.tsx", said.format("z")), ("signed", "a.tsx", said.format(ahead.END)), ("bare", "a.tsx", ahead.END)], "file_id string, path string, text string")
    got = {r["file_id"]: r.asDict(recursive=True) for r in extract.extract(files).collect()}
    other = lambda x: str({k: v for k, v in x.items() if k != "file_id"}).replace("\\x01", "z")
    assert other(got["signed"]) == other(got["plain"]) and got["signed"]["hooks"][0]["arguments"] == [f"'x{ahead.END}'", "1"] and got["bare"]["symbols"] == []


def test_strings_are_cut_as_lists():
    lists = [["a", " ", "é😀"], [], None, ["=>"], ["\n"]]
    texts = pa.array([None if x is None else "".join(p + ahead.END for p in x) for x in lists])
    for at in range(len(lists)):
        (pieces, counts), (want, sizes) = ahead._cut(texts.slice(at)), ahead._cut(pa.array(lists, pa.list_(pa.string())).slice(at))
        assert pieces.to_pylist() == want.to_pylist() and np.array_equal(counts, sizes)
    assert not len(ahead._cut(pa.array([None, ""], pa.string()))[0])


def test_texts_are_cut_in_stretches_and_told_without_themselves(spark):
    files = adapters.sources(spark, HERE)
    plans = {k: str(extract.extract(files, kinds=(k,))._jdf.queryExecution().optimizedPlan()) for k in ("symbols", "errors", "contexts", "components")}
    short = {k: next(x for x in p.splitlines() if "MapInArrow" in x) for k, p in plans.items()}
    assert {k: "text#" in x for k, x in short.items()} == {"symbols": False, "errors": False, "contexts": False, "components": True}
    assert not any("text#" in x and "RepartitionByExpression" in x for p in plans.values() for x in p.split("Union")[0].splitlines())  # texts of lists don't move


def test_errors_are_made_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(report, "stored", lambda df, name: kept.append(name) or df)
    assert report.parser_errors(source_queries._facts(spark, HERE, "errors")).count() and kept == ["parser-errors"]


def test_stretches_are_cut_as_pieces(spark):
    said = ["a=>b==>c = > 'x y'+\"//\" /* é */ `t\n${u}` use_1$\t\r\n{}[]/re'x/g;<a/>\\?", "", " ", "'", "x", "=", "=>", "\x00\x7f\x0b\x0c"]
    cut = [r[0] for r in spark.createDataFrame([(x,) for x in said], "text string").select(extract._pieces(F.col("text"))).collect()]
    ended = [r[0] for r in spark.createDataFrame([(x,) for x in said], "text string").select(F.regexp_replace("text", F.lit(extract._STRETCH), F.lit(f"$0{ahead.END}"))).collect()]
    pieces, counts = ahead._cut(pa.array(ended))
    bounds = np.frombuffer(pieces.buffers()[1], np.int32)
    data = np.frombuffer(pieces.buffers()[2], np.uint8)
    at, sizes = ahead._parted(data, bounds, counts)
    assert sizes.tolist() == [len(x) for x in cut] and [bytes(data[a:b]).decode() for a, b in zip(at[:-1], at[1:], strict=True)] == [p for x in cut for p in x]
    assert ahead._whole(pieces, ahead._places(pieces, np.append(0, np.cumsum(counts)))).to_pylist() == said
