import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.metadata import LEVELS, cleaned, metadata
from sparkloom.operators import rules
from sparkloom.plans import engine
from sparkloom.sources import artifacts


def finding(ctx, rows=None):
    return rules.found(ctx["files"] if rows is None else rows, ctx, "t", F.lit("d"), "r", "do", rules.evidence(), F.col("id"))


def fails(ctx):
    return finding(ctx, ctx["files"].withColumn("id", F.when(F.col("id") == "1", F.raise_error(F.lit("at the first row"))).otherwise(F.col("id"))))


def never_ends(ctx):
    def run(batches):
        time.sleep(3600)
        yield from batches

    return finding(ctx, ctx["files"].mapInArrow(run, "id string, path string"))


def stuck(ctx):
    time.sleep(3600)


@pytest.fixture
def ctx(spark):
    return rules.Context({"files": spark.createDataFrame([("1", "src/a.ts"), ("2", "src/b.ts")], "id string, path string")})


def rule(name, run):
    return rules.Rule(name, "imports", "info", run)


def running(spark):
    return len(spark.sparkContext.statusTracker().getActiveJobsIds())


def test_rules_that_fail_or_never_end_are_reported_and_the_others_stay(spark, ctx):
    own = rules.Rule("own", "imports", "info", lambda c: finding(c).withColumn("metadata", metadata(path=F.col("file"))))
    registry = rules.Registry((rule("fine", finding), rule("fails", fails), rule("never-ends", never_ends), rule("stuck", stuck), rule("unplanned", lambda c: c["none"]), own))
    found, outcomes = rules.execute_apart(ctx, registry, seconds=15, at_once=6)
    assert {o.rule: o.status for o in outcomes} == {"fine": "completed", "fails": "failed", "never-ends": "timed-out", "stuck": "timed-out", "unplanned": "failed", "own": "completed"}
    assert [o.rule for o in outcomes] == sorted(o.rule for o in outcomes)
    assert "at the first row" in next(o.why for o in outcomes if o.rule == "fails") and all(o.seconds < 30 for o in outcomes)
    assert sorted((r["rule_id"], r["file"], r["metadata"].toJson()) for r in found.collect()) == [("fine", "src/a.ts", "{}"), ("fine", "src/b.ts", "{}"), ("own", "src/a.ts", '{"path":"src/a.ts"}'), ("own", "src/b.ts", '{"path":"src/b.ts"}')]
    until = time.time() + 20
    while running(spark) and time.time() < until:
        time.sleep(0.2)
    assert not running(spark)  # the job that never ends is cancelled


def test_the_limit_counts_from_a_rules_own_start(ctx):
    def slow(c):
        time.sleep(1.5)
        return finding(c)

    found, outcomes = rules.execute_apart(ctx, rules.Registry(tuple(rule(f"r{i}", slow) for i in range(4))), seconds=20, at_once=1)
    assert {o.status for o in outcomes} == {"completed"} and found.count() == 8


def test_abort_ends_the_rules(spark, ctx):
    abort = threading.Event()
    threading.Timer(2, abort.set).start()
    began = time.time()
    with pytest.raises(rules.Aborted):
        rules.execute_apart(ctx, rules.Registry((rule("never-ends", never_ends), rule("later", never_ends), rule("last", finding))), at_once=1, abort=abort)
    assert time.time() - began < 30


def test_abort_ends_an_analysis(spark, tmp_path):
    (tmp_path / "package.json").write_text("{}")
    (tmp_path / "a.ts").write_text("export const a = 1")
    abort = threading.Event()
    with pytest.raises(rules.Aborted):
        engine.analyze(spark, str(tmp_path), registry=rules.Registry((rule("never-ends", never_ends),)), abort=abort, progress=lambda stage: stage == "rules" and threading.Timer(1, abort.set).start())
    with pytest.raises(rules.Aborted):
        engine.analyze(spark, str(tmp_path), abort=abort)


def test_private_names_are_gone_at_every_depth(spark):
    told = {"a": {"b": {"apiKey": 1, "kept": [1, {"dbPassword": 2, "n": None}, "x", []]}, "e": {}}, "userName": {"kept": 1}, "z": 1.5, "t": True}
    rows = [(1, json.dumps(told)), (2, "null"), (3, None), (4, "[]"), (5, '"apiKey"'), (6, json.dumps({"setCookie": 1}))]
    got = {r["i"]: r["v"] and json.loads(r["v"].toJson()) for r in spark.createDataFrame(rows, "i int, t string").select("i", cleaned(F.parse_json("t")).alias("v")).collect()}
    assert got == {i: t and artifacts.sanitized(json.loads(t)) for i, t in rows}
    deep = "1"
    for _ in range(LEVELS + 2):
        deep = '{"k":' + deep + "}"
    told = spark.createDataFrame([(deep,)], "t string").select(cleaned(F.parse_json("t")).alias("v")).first()["v"].toJson()
    assert told == '{"k":' * LEVELS + "null" + "}" * LEVELS
    endless = spark.range(1).select(cleaned(F.to_variant_object(F.create_map(F.lit("n"), F.lit(float("nan")), F.lit("m"), F.lit(1.5)))).alias("v"))
    assert json.loads(endless.first()["v"].toJson()) == {"m": 1.5, "n": None}


def test_metadata_is_cleaned_in_the_artifact_and_in_the_tables_written_whole(spark, tmp_path):
    home = tmp_path / "home"
    home.mkdir()
    (home / "package.json").write_text("{}")
    (home / "a.ts").write_text("import './b'; import './gone'; import 'lib'\nexport function f() {}\n")
    (home / "b.ts").write_text("export const b = 1")
    private = F.parse_json(F.lit('{"one":{"two":{"apiKey":"k","kept":3}},"token":"t"}'))
    done = engine.analyze(spark, str(home), registry=rules.Registry((rule("own", lambda c: finding(c).withColumn("metadata", private)),)))
    assert {o.status for o in done.outcomes} == {"completed"}
    out = done.artifact("2024-01-01T00:00:00Z")
    assert [f["metadata"] for f in out["findings"]] == [{"one": {"two": {"kept": 3}}}] * 2
    nodes = {n["label"]: n["metadata"] for n in out["graph"]["nodes"]}
    assert nodes["./gone"] == {"missing": True} and nodes["lib"] == {} and nodes["a.ts"].items() >= {"functionCount": 1, "lineCount": 3}.items() and "fileId" in nodes["a.ts"]
    artifacts.as_json(out)
    place = done.write((tmp_path / "whole").as_uri())
    for name in ("findings", "nodes"):
        text = "".join(p.read_text() for p in (tmp_path / "whole" / name).glob("part-*"))
        assert place[name]["rows"] and "apiKey" not in text and "token" not in text and '"metadata":{' in text
