"""The input tables in the operators' shapes: findings, graphs, modules and imports, history."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import half_up
from ..functions.session import table
from ..operators.score import choose

SEVERITY = {"error": "critical", "purchase": "error", "click": "warning", "signup": "warning", "view": "info"}
CATEGORY = {"error": "architecture", "purchase": "performance", "click": "imports", "signup": "hooks", "view": "components"}
RULE = {"error": "god-module", "purchase": "heavy-import-hub", "click": "duplicate-imports", "signup": "too-many-hooks", "view": "unused-export"}


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event as a finding of its type's rule, in its user's file."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    kind = F.col("event_type")
    said = F.concat(kind, F.lit(" "), (F.col("event_id") % 2).cast("string"))
    return e.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.col("event_id").alias("pos"), choose(kind, RULE).alias("rule_id"), choose(kind, CATEGORY).alias("category"), choose(kind, SEVERITY).alias("severity"),
        F.concat(kind, F.lit(" finding")).alias("title"), said.alias("description"), F.concat(F.lit("Review "), said).alias("recommendation"),
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("file"), (F.col("event_id") % 20 + 1).cast("int").alias("line"), F.lit(1).alias("column"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By day the share of events that are no errors, as a score."""
    e = table(spark, sf_dir, "events").select("ts", "event_type")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("generated_at")).agg(half_up(100 - 100.0 * F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))).alias("overall"))


def _id(prefix: str, column: str) -> F.Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def key_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, customers, nations and regions as nodes."""
    parts = (("orders", "o", "o_orderkey", "module"), ("customer", "c", "c_custkey", "module"), ("nation", "n", "n_nationkey", "package"), ("region", "r", "r_regionkey", "missing"))
    out = None
    for name, prefix, column, kind in parts:
        one = table(spark, sf_dir, name).select(_id(prefix, column).alias("id"), F.lit(name).alias("label"), F.concat(F.lit(f"src/{name}/"), F.col(column).cast("string")).alias("path"), F.lit(kind).alias("type"))
        out = one if out is None else out.unionByName(one)
    return out


def key_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order to customer, customer to nation, nation to region: no cycles, one edge out at most."""
    parts = (("orders", "o", "o_orderkey", "c", "o_custkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey"))
    out = None
    for name, a, source, b, target in parts:
        one = table(spark, sf_dir, name).select(_id(a, source).alias("source"), _id(b, target).alias("target"))
        out = one if out is None else out.unionByName(one)
    return out


def supply_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item as a statement by which a part depends on a supplier; dynamic if it was returned."""
    return table(spark, sf_dir, "lineitem").select(_id("p", "l_partkey").alias("source"), _id("s", "l_suppkey").alias("target"), (F.col("l_returnflag") == "R").alias("is_dynamic"), F.lit(False).alias("is_broken"), F.lit(False).alias("is_external"), "l_shipdate")


def supply_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(_id("p", "p_partkey").alias("id"), F.col("p_name").alias("label"), _id("p", "p_partkey").alias("path"), F.lit("module").alias("type"))
    return p.unionByName(table(spark, sf_dir, "supplier").select(_id("s", "s_suppkey").alias("id"), F.col("s_name").alias("label"), _id("s", "s_suppkey").alias("path"), F.lit("module").alias("type")))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation to the other nation whose suppliers it orders from most often (of equals the lower)."""
    l, o, c, s = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer", "supplier"))
    pairs = l.select("l_orderkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", F.col("c_nationkey").alias("source")), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", F.col("s_nationkey").alias("target")), F.col("l_suppkey") == F.col("s_suppkey"))
    n = pairs.where("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    best = n.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "target"))).where("r = 1")
    return best.select(F.col("source").cast("long"), F.col("target").cast("long"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files: src/<source>/<lang>/m<id>.ts."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit("/m"), F.col("doc_id").cast("string"), F.lit(".ts"))
    return d.select(F.col("doc_id").cast("string").alias("id"), "doc_id", path.alias("path"), "source", "lang", F.col("n_chars").alias("size"))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit("/m"), F.col("doc_id").cast("string"), F.lit(".ts"))
    f = d.select(F.col("doc_id").cast("string").alias("id"), path.alias("path"), "text")
    return f.select("id", F.col("id").alias("file_id"), "path", F.size(F.split("text", "\n", -1)).alias("line_count"), F.lit(3).alias("n_imports"), F.lit(1).alias("n_exports"), F.lit(0).alias("function_count"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three from each file: its neighbour by a relative path, by an alias, and a package."""
    f = files(spark, sf_dir)
    near = F.concat(F.lit("m"), (F.col("doc_id") + 20).cast("string"))
    told = F.array(
        F.struct(F.concat(F.lit("./../"), "lang", F.lit("/./"), near).alias("source"), F.lit("relative").alias("type"), F.lit(1).alias("line")),
        F.struct(F.concat(F.lit("@/"), "source", F.lit("/"), "lang", F.lit("/"), near).alias("source"), F.lit("package").alias("type"), F.lit(2).alias("line")),
        F.struct(F.concat(F.lit("pkg"), (F.col("doc_id") % 7).cast("string")).alias("source"), F.lit("package").alias("type"), F.lit(3).alias("line")),
    )
    return f.select(F.col("id").alias("file_id"), F.explode(told).alias("x")).select("file_id", F.lit(False).alias("is_dynamic"), F.lit(False).alias("is_type_only"), "x.line", "x.source", F.array().cast("array<string>").alias("specifiers"), "x.type")


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One from each file, named by its first word; no re-exports."""
    d = table(spark, sf_dir, "documents")
    name = F.substring_index(F.regexp_replace("text", "\n", " "), " ", 1)
    return d.select(F.col("doc_id").cast("string").alias("file_id"), (F.col("doc_id") % 10 == 0).alias("is_anonymous"), (F.col("doc_id") % 5 == 0).alias("is_default"), F.lit(False).alias("is_type_only"), F.lit(1).alias("line"), name.alias("name"), F.lit(None).cast("string").alias("source"))


def page_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of the pages, as imports."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").cast("string").alias("file_id"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("source"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' paths as routes."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").cast("string").alias("file_id"), F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path"), F.lit(1).alias("line"))


#: Rows of a task that makes texts from keys.
DEALT = 10_000
#: A source file of part #k; #n1 is k + 1 and so on, #m3 the rest of k by 3; every second default export has no name, every fourth file an open bracket.
SOURCE = """import React, { useState as s#k, type Kind } from "react";
import * as all from './p#n1';
import "./missing#m3.css";
import type { T#k } from "@/lib/u#m5";
// import x from "not-this";
const text = "import y from 'nor-this'";
const lazy#k = () => import("./p#n2");
export { a as b#k } from "./p#n1";
export * from "./p#n3";
export const Panel#k = ({ one, two }, three) => { const [v] = useState(#k); useEffect(() => {}); return <div><p>Don't<br/></p></div>; };
export default function #app(props) {
  const ctx = useContext(Theme#k);
  return <Routes><Route path="/deep/#m10" element={<Panel#k/>} /></Routes>;
}

const Theme#k = createContext(null);
interface Shape#k { x: number }
enum Color { Red }
const #end(1;
"""


def _dealt(rows: DataFrame, by: str) -> DataFrame:
    """rows by a key in partitions of about DEALT: a table of keys is a few small files, whose texts one task each would make. The number is given, as what is planned from the keys' bytes alone would join them again."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // DEALT)), by)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as source files: file_id, path, text."""
    k = F.col("p_partkey")
    tokens = {"#n1": k + 1, "#n2": k + 2, "#n3": k + 3, "#m10": k % 10, "#m3": k % 3, "#m5": k % 5, "#app": F.when(k % 2 == 0, F.concat(F.lit("App"), k.cast("string"))).otherwise(F.lit("")), "#end": F.when(k % 4 == 0, F.lit("broken = (")).otherwise(F.lit("fine = 1; const more = 1; //")), "#k": k}
    said = re.split(f"({'|'.join(tokens)})", SOURCE)  # put together once, in place of a replacement for each token
    text = F.concat(*(tokens[x].cast("string") if x in tokens else F.lit(x) for x in said))
    return _dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(_id("p", "p_partkey").alias("file_id"), F.concat(F.lit("src/p"), k.cast("string"), F.lit(".tsx")).alias("path"), text.alias("text"))


#: Statements of item (part #p, supplier #s) of an order, by the rest of part plus supplier by 10.
STATEMENTS = (
    'import D#p, { a as b#p, type T } from "./s#s"; // import no from "no"',
    "import type {\n  T#p, // said { here }\n} from 'pkg#s';",
    'const m#p = await import("./s#s");',
    'export { a as e#p, type Z#p } from "./s#s";',
    "export type * as n#p from './s#s';",
    "export const v#p = `export const no = '{' ${no}`; /* import 'no' } */",
    "export async function f#p(a, [b, c]) {\n  const x = /[{\"']/;\n  return useThing#s(a, [1, { b: 2 }]);\n}",
    "export abstract class K#p extends Base {\n  m() { const inner = { a: 1 }; }\n}",
    "const P#p = memo(({ q, r }, ref) => <a>{use#s(q)}<b/></a>);",
    "export default ({ w }) => { useEffect(() => { go#s(`} ${w}`); }, []); };",
)


def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as source files, a statement for each item: file_id, path, text."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("items"))  # as many as an order has
    forms = F.array(*(F.lit(x) for x in STATEMENTS))

    def statement(x: Column) -> Column:
        form = F.get(forms, ((x["l_partkey"] + x["l_suppkey"]) % len(STATEMENTS)).cast("int"))
        return F.replace(F.replace(form, F.lit("#p"), x["l_partkey"].cast("string")), F.lit("#s"), x["l_suppkey"].cast("string"))

    return items.select(_id("o", "l_orderkey").alias("file_id"), F.concat(F.lit("src/o"), F.col("l_orderkey").cast("string"), F.lit(".tsx")).alias("path"), F.array_join(F.transform("items", statement), "\n").alias("text"))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as modules whose measures are taken from the part's size; every third is an index file."""
    k, n = F.col("p_partkey"), F.col("p_size")
    path = F.concat(F.lit("src/g"), (k % 40).cast("string"), F.lit("/"), F.when(k % 3 == 0, F.lit("index.ts")).otherwise(F.concat(F.lit("p"), k.cast("string"), F.lit(".ts"))))
    return table(spark, sf_dir, "part").select(_id("p", "p_partkey").alias("id"), _id("p", "p_partkey").alias("file_id"), path.alias("path"), (n * 12).alias("line_count"), (n + (k % 20).cast("int")).alias("n_imports"), n.alias("n_exports"), F.lit(1).alias("function_count"))


def measured_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One component in each of those modules."""
    n = F.col("p_size")
    names = lambda m: F.transform(F.sequence(F.lit(0), n % m), lambda i: F.concat(F.lit("x"), i.cast("string")))
    return table(spark, sf_dir, "part").select(_id("p", "p_partkey").alias("file_id"), F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("name"), (n * 10).alias("line_count"), names(15).alias("props"), (n % 12).alias("jsx_depth"), names(20).alias("hooks"))


def measured_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("id", "path")


#: Paths of part #k that a scan passes by or keeps, by the rest of k by 8.
LISTED = (".hidden/p#k.ts", "src/p#k.test.ts", "src/p#k.stories.tsx", "src/p#k.d.ts", "node_modules/q/p#k.js", "src/.p#k.ts", "src/P#k.JSX", "src/p#k.spec.mjs")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.replace(F.get(F.array(*map(F.lit, LISTED)), (k % len(LISTED)).cast("int")), F.lit("#k"), k.cast("string"))
    return table(spark, sf_dir, "part").select(path.alias("path"), F.col("p_size").cast("long").alias("size"), F.lit(0).alias("last_modified"))
