from pyspark.sql import functions as F

from sparkloom.operators import extract
from sparkloom.plans import adapters

HERE = "/root/testdata/sf0.001"


def test_kinds_asked_alone_are_those_of_all_without_windows_they_do_not_need(spark):
    files = adapters.composed(spark, HERE).limit(60).unionByName(adapters.sources(spark, HERE).limit(20)).unionByName(spark.createDataFrame([("n", "n.ts", None), ("r", "r.ts", "a = 3 / 2 / 1; b = /x'/g; ( ]")], "file_id string, path string, text string"))
    files = files.localCheckpoint()
    whole = extract.extract(files)
    want = {r["file_id"]: r for r in whole.collect()}
    for kinds in (("symbols",), ("hooks", "contexts", "routes"), ("imports", "exports", "errors", "module")):
        done = extract.extract(files, kinds=kinds)
        assert {*done.columns} == {"file_id", "path", *kinds}
        got = {r["file_id"]: r for r in done.collect()}
        assert {*got} == {*want}
        for k in kinds:
            assert {i: r[k] for i, r in got.items()} == {i: r[k] for i, r in want.items()}, k
    few = extract.extract(files, kinds=("symbols",))
    count = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Window [")
    assert count(few) < count(whole) / 2


def test_partitions_follow_the_texts(spark, monkeypatch):
    files = spark.range(64).select(F.col("id").cast("string").alias("file_id"), F.lit("a.ts").alias("path"), F.repeat(F.lit("a "), 100).alias("text"))
    monkeypatch.setattr(extract, "TASK_TEXT", 1000)
    assert extract._texts(files).rdd.getNumPartitions() == 13
