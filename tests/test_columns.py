import re

from pyspark.sql import functions as F

from sparkloom.functions import columns as c


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_rounding_goes_up_on_the_binary_value(spark):
    assert [one(spark, c.half_up(F.lit(x))) for x in (1.005, 2.345, -1.125, 0.0)] == [1.0, 2.35, -1.12, 0.0]


def test_paths(spark):
    for directory, spec, out in (("src/a", "../b/./c", "src/b/c"), (".", "./x", "x"), ("a", "../../x", "../x"), ("a", "..", "."), ("src", "./b.js", "src/b.js")):
        assert one(spark, c.join_path(F.lit(directory), F.lit(spec))) == out
    assert [one(spark, c.dirname(F.lit(p))) for p in ("a", "a/b", "/a", "a/b/c")] == [".", "a", "/", "a/b"]
    assert [one(spark, c.basename(F.lit(p))) for p in ("a", "a/b.ts", "a/")] == ["a", "b.ts", "a"]
    assert [one(spark, c.extension(F.lit(p))) for p in ("a.ts", ".env", "x/a.test.tsx", "a")] == [".ts", "", ".tsx", ""]
    assert one(spark, c.normalized(F.lit(r"a\b//c"))) == "a/b/c"
    assert [one(spark, c.without_source_extension(F.lit(p))) for p in ("a.mts", "a.jsx", "a.css")] == ["a", "a", "a.css"]


def test_two_kinds_of_globs():
    assert re.search(c.ignore_glob("generated/**"), "src/generated/x.ts")
    assert re.search(c.ignore_glob("*.gen.ts"), "src/a.gen.ts") and not re.search(c.ignore_glob("/a*"), "b/c/xa/d")
    assert re.search(c.policy_glob("./src/*/x.ts"), "src/a/x.ts") and not re.search(c.policy_glob("src/*"), "src/a/b")
    assert not re.search(c.policy_glob("src/**"), "lib/src/a")


def test_measures(spark):
    text = "a\n\n// no\n/* no\n * no\n b\r\n"
    assert one(spark, c.logical_lines(F.lit(text))) == 2 and one(spark, c.physical_lines(F.lit(text))) == 7
    assert one(spark, c.route_depth(F.lit("/a//b/"))) == 2 and one(spark, c.parent_steps(F.lit("../../a"))) == 2
    assert [one(spark, c.nesting_depth(F.lit(x))) for x in ("<a><b/></a>", "<a><b><c/></b></a>", "x", "<><p>t</p></>")] == [2, 3, 0, 2]


def test_keys_are_digests_of_the_joined_parts(spark):
    import hashlib

    assert one(spark, c.key("edge", F.lit("a"), F.lit(1))) == hashlib.sha256(b"edge:a:1").hexdigest()
    assert one(spark, c.key("edge", F.lit(None).cast("string"))) is None
