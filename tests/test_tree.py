import os

import pytest
from pyspark.sql import functions as F

from sparkloom.plans import engine
from sparkloom.sources import project, tree


@pytest.fixture
def home(tmp_path):
    top = tmp_path / "home"
    for name in ("package.json", "src/a.ts", "src/b.test.ts", "src/deep/er/c.tsx", "src/note.md", "src/d.gen.ts", "node_modules/q/index.js", "skipped/y.ts", ".hidden/z.ts", ".eslintrc.js"):
        p = top / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("{}" if name.endswith(".json") else f"export const x = '{name}'\n")
    with open(top / "src/huge.ts", "wb") as f:  # holes on disk, so it costs nothing
        f.truncate(3 << 30)
    with open(top / "src/huge.bin", "wb") as f:
        f.truncate(3 << 30)
    return top


def paths(df, kind="file"):
    return sorted(r["path"] for r in df.where(F.col("kind") == kind).collect())


@pytest.mark.parametrize("wide", [1, 3, 64])
def test_a_tree_is_dealt_out_by_directory(spark, home, monkeypatch, wide):
    monkeypatch.setattr(tree, "WIDE", wide)
    reader = tree.TreeReader({"path": str(home), "passed_by": '["node_modules"]'})
    looked = []
    here = tree.Walk.here
    monkeypatch.setattr(tree.Walk, "here", lambda self, *a: looked.append(a) or here(self, *a))
    parts = reader.partitions()
    assert len(looked) <= wide and all("node_modules" not in p.directory for p in parts)
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["path"] for r in rows if r["kind"] == "file") == [".eslintrc.js", "package.json", "skipped/y.ts", "src/a.ts", "src/b.test.ts", "src/d.gen.ts", "src/deep/er/c.tsx", "src/huge.bin", "src/huge.ts", "src/note.md"]
    assert [r["path"] for r in rows if r["kind"] == "hidden"] == [".hidden"]
    assert len([r for r in rows if r["kind"] == "directory"]) == 5


def test_filters_reach_the_source(spark, home):
    """Of all files those of 3 GB are never opened: they would not fit a row."""
    got = tree.tree(spark, str(home), passed_by=project.IGNORED_DIRECTORIES, contents=True).where((F.col("size") <= 1000) & F.col("extension").isin(".ts", ".tsx") & ~F.col("is_test") & (F.col("kind") == "file") & ~F.col("is_generated"))
    assert {r["path"]: bytes(r["content"]).decode() for r in got.collect()} == {p: f"export const x = '{p}'\n" for p in ("skipped/y.ts", "src/a.ts", "src/deep/er/c.tsx")}
    some = tree.tree(spark, str(home)).where(F.col("path").startswith("src/deep") | (F.col("size") > 5)).where(F.col("name") != "c.tsx")
    assert "src/deep/er/c.tsx" not in paths(some) and "src/a.ts" in paths(some)


def test_only_kept_files_are_opened(spark, home, monkeypatch):
    listing = project.listed(spark, str(home), ("skipped/**", "skipped"))
    files = project.scan(listing, ("skipped/**",))
    assert {r["path"]: r["is_skipped"] for r in files.collect()} == {"src/a.ts": False, "src/deep/er/c.tsx": False, "src/d.gen.ts": False, "src/huge.ts": True}
    got = {r["path"] for r in project.contents(spark, str(home), files).collect()}
    assert got == {"src/a.ts", "src/deep/er/c.tsx"}
    done = engine.analyze(spark, str(home))
    assert not done.failed_rules and done.tables["modules"].count() == 3  # skipped/y.ts too, as there is no ignore file


def test_links_are_followed_once_and_loops_end(spark, home, tmp_path):
    out = tmp_path / "outside"
    (out / "lib/node_modules/z").mkdir(parents=True)
    for p in (out / "lib/o.ts", out / "lib/node_modules/z/n.ts", out / "single.ts"):
        p.write_text("x")
    (home / "src/loop").symlink_to(home / "src", target_is_directory=True)
    (home / "src/up").symlink_to(home, target_is_directory=True)
    (home / "src/lib").symlink_to(out / "lib", target_is_directory=True)
    (home / "src/again").symlink_to(out / "lib", target_is_directory=True)
    (home / "src/module").symlink_to(home / "node_modules/q", target_is_directory=True)
    (home / "src/broken").symlink_to(home / "nowhere")
    (home / "src/single.ts").symlink_to(out / "single.ts")
    (out / "lib/back").symlink_to(home / "src", target_is_directory=True)
    (out / "lib/more").symlink_to(tmp_path / "third", target_is_directory=True)
    (tmp_path / "third/in").mkdir(parents=True)
    (tmp_path / "third/in/t.ts").write_text("x")
    (tmp_path / "third/loop").symlink_to(out, target_is_directory=True)
    never = {r["path"] for r in project.scan(project.listed(spark, str(home))).collect()}
    assert never == {"src/a.ts", "src/deep/er/c.tsx", "src/d.gen.ts", "src/huge.ts", "skipped/y.ts"}
    rows = [r["path"] for r in project.scan(project.listed(spark, str(home), follow_links=True)).collect()]
    assert len(rows) == len({*rows})
    # what a link leads to is entered whatever it is called; the directories below it are chosen as ever
    assert {*rows} == never | {"../outside/lib/o.ts", "../outside/single.ts", "../third/in/t.ts", "node_modules/q/index.js"}
    assert {os.path.normpath(r["path"]) for r in project.contents(spark, str(home), project.scan(project.listed(spark, str(home), follow_links=True))).collect()} >= {"../outside/lib/o.ts", "node_modules/q/index.js"}


def test_an_empty_tree_and_an_unreadable_one(spark, tmp_path):
    assert [r["path"] for r in tree.tree(spark, str(tmp_path)).collect()] == ["."]
    assert tree.tree(spark, str(tmp_path / "none")).count() == 0
    assert [r["path"] for r in tree.follow(tree.tree(spark, str(tmp_path)), str(tmp_path)).collect()] == ["."]
