import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.order import in_ranges, ranked
from sparkloom.operators import rules
from sparkloom.operators.table_rules import TableRule, as_rule, found, register
from sparkloom.plans import engine
from sparkloom.sources import artifacts


def test_ranks_and_files_in_order(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.randrange(500), k) for k in range(3000)] + [(None, -1)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    got = sorted((x["position"], x["a"], x["b"]) for x in ranked(df, "a", "b").collect())
    assert got == [(k, *x) for k, x in enumerate(want)]
    down = sorted((x["position"], x["b"]) for x in ranked(df, F.desc("b")).collect())
    assert [b for _, b in down] == sorted((b for _, b in rows), reverse=True)
    assert ranked(df.limit(0), "a").count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several ranges, however small
    try:
        in_ranges(df, "a", "b").write.json(str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    files = sorted((tmp_path / "t").glob("part-*"))
    assert len(files) > 1 and [(x.get("a"), x["b"]) for f in files for x in map(json.loads, f.read_text().splitlines())] == want


def test_whole_tables_are_written_in_order(spark, tmp_path):
    home = tmp_path / "home"
    home.mkdir()
    (home / "package.json").write_text("{}")
    for k in range(12):
        (home / f"m{k}.ts").write_text(f"import x from './m{(k * 5 + 1) % 12}'\nimport './gone{k}'\nexport const a{k} = (x\n")
    done = engine.analyze(spark, str(home))
    place = done.write((tmp_path / "whole").as_uri())
    assert {*place} >= {"findings", "risks", *engine.ORDERS}
    read = lambda n: [json.loads(x) for f in sorted((tmp_path / "whole" / n).glob("part-*")) for x in f.read_text().splitlines()]
    for name, by in engine.ORDERS.items():
        keys = [tuple(r.get(c) for c in by) for r in read(name)]
        assert keys == sorted(keys) and len(keys) == place[name]["rows"], name
    assert [r["id"] for r in read("findings")] == [r["id"] for r in rules.in_order(done.published()).collect()]


class Crowded(TableRule):
    """Files with many rows; a field without a default is no threshold."""

    by, order = ("file_id",), ("line",)
    most: int = 2
    word: str = "rows"

    def begin(self):
        self.lines = []

    def eval(self, row):
        self.lines.append(row["line"])
        self.file = row["file_id"]

    def end(self):
        if len(self.lines) > self.most:
            yield found("Crowded", f"{len(self.lines)} {self.word}", self.file, self.lines[0], n=len(self.lines), most=self.most)


@pytest.fixture
def imports(spark):
    return spark.createDataFrame([("f1", 9), ("f1", 2), ("f2", 1), ("f1", 4), ("f3", 5), ("f3", 6), ("f3", 7), ("f3", 8)], "file_id string, line int")


def test_a_rule_from_sql_with_its_thresholds(spark, imports):
    register(spark, "crowded", Crowded)
    imports.createOrReplaceTempView("some_imports")
    ask = lambda more="": sorted((r["file_id"], r["line"], r["description"], [tuple(e) for e in r["evidence"]]) for r in spark.sql(f"SELECT * FROM crowded(TABLE(some_imports){more})").collect())
    assert ask() == [("f1", 2, "3 rows", [("n", "3"), ("most", "2")]), ("f3", 5, "4 rows", [("n", "4"), ("most", "2")])]
    assert ask(", most => 3, word => 'lines'") == [("f3", 5, "4 lines", [("n", "4"), ("most", "3")])]
    for wrong in (", least => 3", ", most => 'x'", ", most => NULL", ", word => 3"):
        with pytest.raises(Exception, match="threshold|is no"):
            ask(wrong)
    with pytest.raises(Exception, match="the table has no"):
        spark.sql("SELECT * FROM crowded(TABLE(SELECT 1 AS file_id))").collect()
    assert spark.sql("SELECT * FROM crowded(TABLE(SELECT * FROM some_imports WHERE line > 99))").count() == 0


def test_a_rule_of_others_runs_beside_the_catalogue(spark, imports):
    files = spark.createDataFrame([("f1", "src/a.ts"), ("f3", "src/c.ts")], "id string, path string")
    own = as_rule("crowded", "imports", "error", Crowded, "imports")
    fan = next(r for r in rules.RULES if r.id == "excessive-file-count")
    ctx = rules.Context({"files": files, "imports": imports}, thresholds={"crowded": {"most": 3}, "excessive-file-count": {"maxFiles": 1}})
    for run in (rules.execute, rules.execute_apart):
        got, _ = run(ctx, rules.Registry((own, fan)))
        assert sorted((r["rule_id"], r["severity"], r["file"], r["line"], r["description"]) for r in got.collect()) == [("crowded", "error", "src/c.ts", 5, "4 rows"), ("excessive-file-count", "warning", ".", 1, "src contains 2 files.")]
    assert rules.scheduled(rules.Registry((own,)), rules.Context({"files": files})) == []


def test_one_timeline_over_versions_of_the_artifact(spark, tmp_path):
    legacy = lambda at, score: {"metadata": {"generatedAt": at, "schemaVersion": 1}, "summary": {"overallScore": score}, "more": [1]}
    now = lambda at, score: {"metadata": {"generated_at": at, "version": artifacts.VERSION}, "summary": {"overall": score, "grade": "A"}}
    for name, told in {
        "analysis-1": legacy("2023-01-01", 50), "analysis-2": legacy("2023-02-01", 61.5), "history/analysis-2": now("2024-01-01", 70.25), "history/analysis-3": now("2024-02-01", 71), "history/x": {"metadata": {}, "summary": {}},
        "history/y": [1], "history/z": legacy(5, 50), "history/w": legacy("2023-03-01", "50"), "history/v": legacy("2023-03-01", None),
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.json").write_text(json.dumps(told))
    (tmp_path / "history/broken.json").write_text("{")
    (tmp_path / "history/empty.json").write_text("")
    (tmp_path / "report-1.html").write_text("page")
    want = [("legacy", "2023-01-01", 50.0), ("legacy", "2023-02-01", 61.5), ("1.0.0", "2024-01-01", 70.25), ("1.0.0", "2024-02-01", 71.0)]
    assert [tuple(r)[:3] for r in artifacts.archived(spark, str(tmp_path)).collect()] == want
    moved = artifacts.migrate_archives(tmp_path)
    assert sorted(p.name for p in moved) == ["analysis-1.json", "analysis-2-2.json", "report-1.html"] and not [*tmp_path.glob("*.json")]
    got = artifacts.archived(spark, str(tmp_path)).collect()
    assert [tuple(r)[:3] for r in got] == want and got[0]["report"] == "history/report-1.html"
    assert [r["overall"] for r in artifacts.archived(spark, str(tmp_path), most=2).collect()] == [70.25, 71.0]
    assert artifacts.history(spark, str(tmp_path)).count() == 4 and artifacts.history(spark, str(tmp_path / "none")).count() == 0
