"""Extraction from sources, resolution of what it finds, and the rules on sizes, over parts told as source files and modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import nesting_depth, normalized
from ..functions.session import stored
from ..operators import extract, graph, report, resolve, search
from ..sources import project
from . import adapters as a
from .registry import query, run_rule, told

_FILE = "'p:' || p_partkey"
_K = "p_partkey"


def _facts(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return extract.kind_of(extract.extract(a.sources(spark, d), kinds=(kind,)), kind)


_IMPORTS = f"""i AS (SELECT {_FILE} AS file_id, unnest([
  {{'line': 1, 'source': 'react', 'type': 'package', 'specifiers': 'React|s' || {_K} || '|Kind', 'is_dynamic': false, 'is_type_only': false}},
  {{'line': 2, 'source': './p' || ({_K} + 1), 'type': 'relative', 'specifiers': '* as all', 'is_dynamic': false, 'is_type_only': false}},
  {{'line': 3, 'source': './missing' || ({_K} % 3) || '.css', 'type': 'relative', 'specifiers': '', 'is_dynamic': false, 'is_type_only': false}},
  {{'line': 4, 'source': '@/lib/u' || ({_K} % 5), 'type': 'package', 'specifiers': 'T' || {_K}, 'is_dynamic': false, 'is_type_only': true}},
  {{'line': 7, 'source': './p' || ({_K} + 2), 'type': 'dynamic', 'specifiers': '', 'is_dynamic': true, 'is_type_only': false}}], recursive := true) FROM part)"""
_EXPORTS = f"""e AS (SELECT {_FILE} AS file_id, unnest([
  {{'line': 8, 'name': 'b' || {_K}, 'source': './p' || ({_K} + 1), 'is_default': false, 'is_anonymous': false, 'is_type_only': false}},
  {{'line': 9, 'name': '*', 'source': './p' || ({_K} + 3), 'is_default': false, 'is_anonymous': false, 'is_type_only': false}},
  {{'line': 10, 'name': 'Panel' || {_K}, 'source': NULL, 'is_default': false, 'is_anonymous': false, 'is_type_only': false}},
  {{'line': 11, 'name': CASE WHEN {_K} % 2 = 0 THEN 'App' || {_K} ELSE 'default' END, 'source': NULL, 'is_default': true, 'is_anonymous': {_K} % 2 = 1, 'is_type_only': false}}], recursive := true) FROM part)"""


@query(f"WITH {_IMPORTS} SELECT file_id, line, source, type, specifiers, is_dynamic, is_type_only FROM i")
def extract_imports(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "imports").withColumn("specifiers", F.array_join("specifiers", "|"))


@query(f"WITH {_EXPORTS} SELECT file_id, line, name, source, is_default, is_anonymous, is_type_only FROM e")
def extract_exports(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "exports")


@query(f"""SELECT {_FILE} AS file_id, 'Panel' || {_K} AS name, 'arrow' AS type, 1 AS line_count, 3 AS jsx_depth, 'Panel' || {_K} AS exports, 'useEffect|useState' AS hooks, '{{ one, two }}|three' AS props FROM part
UNION ALL SELECT {_FILE}, 'App' || {_K}, 'function', 4, 2, 'App' || {_K}, 'useContext', 'props' FROM part WHERE {_K} % 2 = 0""")
def extract_components(spark: SparkSession, d: str) -> DataFrame:
    rows = _facts(spark, d, "components")
    return rows.select("file_id", "name", "type", "line_count", "jsx_depth", *(F.array_join(c, "|").alias(c) for c in ("exports", "hooks", "props")))


_BEFORE = "len('export const Panel') + len(p_partkey::VARCHAR) + len(' = ({ one, two }, three) => { const [v] = ') + 1"


@query(f"""SELECT {_FILE} AS file_id, 'useState' AS name, 10 AS line, ({_BEFORE})::INTEGER AS "column", p_partkey::VARCHAR AS arguments FROM part
UNION ALL SELECT {_FILE}, 'useEffect', 10, ({_BEFORE} + len('useState(); ') + len(p_partkey::VARCHAR))::INTEGER, '() => {{}}' FROM part
UNION ALL SELECT {_FILE}, 'useContext', 12, 15, 'Theme' || {_K} FROM part""")
def extract_hooks(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "hooks").select("file_id", "name", "line", "column", F.array_join("arguments", "|").alias("arguments"))


@query(f"SELECT {_FILE} AS file_id, 'useContext' AS name, 'use' AS kind, 12 AS line FROM part UNION ALL SELECT {_FILE}, 'createContext', 'create', 16 FROM part")
def extract_contexts(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "contexts").select("file_id", "name", "kind", "line")


@query(f"SELECT {_FILE} AS file_id, '/deep/' || ({_K} % 10) AS path, 'react-router' AS kind, 13 AS line FROM part")
def extract_routes(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "routes").select("file_id", "path", "kind", "line")


@query(f"""SELECT {_FILE} AS file_id, unnest([{{'name': 'text', 'type': 'variable', 'line': 6}}, {{'name': 'lazy' || {_K}, 'type': 'variable', 'line': 7}}, {{'name': 'Panel' || {_K}, 'type': 'variable', 'line': 10}}, {{'name': 'ctx', 'type': 'variable', 'line': 12}},
  {{'name': 'Theme' || {_K}, 'type': 'variable', 'line': 16}}, {{'name': 'Shape' || {_K}, 'type': 'interface', 'line': 17}}, {{'name': 'Color', 'type': 'enum', 'line': 18}}, {{'name': CASE WHEN {_K} % 4 = 0 THEN 'broken' ELSE 'fine' END, 'type': 'variable', 'line': 19}}], recursive := true) FROM part
UNION ALL SELECT {_FILE}, 'App' || {_K}, 'function', 11 FROM part WHERE {_K} % 2 = 0 UNION ALL SELECT {_FILE}, 'more', 'variable', 19 FROM part WHERE {_K} % 4 <> 0""")
def extract_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "symbols").select("file_id", "name", "type", "line")


@query(f"SELECT {_FILE} AS file_id, 19 AS line, 17 AS \"column\", '( isn''t closed' AS message, 'error' AS severity FROM part WHERE {_K} % 4 = 0")
def extract_errors(spark: SparkSession, d: str) -> DataFrame:
    return report.parser_errors(_facts(spark, d, "errors"))


@query(f"SELECT {_FILE} AS file_id, 'src/p' || {_K} || '.tsx' AS path, 5 AS n_imports, 4 AS n_exports, CASE WHEN {_K} % 2 = 0 THEN 1 ELSE 0 END AS function_count, 20 AS line_count, sha256({_FILE} || ':module') AS id FROM part")
def extract_modules(spark: SparkSession, d: str) -> DataFrame:
    return extract.modules(extract.extract(a.sources(spark, d), kinds=("imports", "exports", "module")))


# --- sources composed of an order's items: each file has its own statements, which the SQL takes from the items -----------------

_ITEMS = """i AS (SELECT 'o:' || l_orderkey AS file_id, l_partkey::VARCHAR AS p, l_suppkey::VARCHAR AS s, (l_partkey + l_suppkey) % 10 AS form, [1, 3, 1, 1, 1, 1, 4, 3, 1, 1][(l_partkey + l_suppkey) % 10 + 1] AS high,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem),
c AS (SELECT *, (1 + coalesce(sum(high) OVER (PARTITION BY file_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS line FROM i)"""


def _composed(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return extract.kind_of(extract.extract(a.composed(spark, d), kinds=(kind,)), kind)


@query(f"""WITH {_ITEMS} SELECT file_id, line, CASE WHEN form = 1 THEN 'pkg' || s ELSE './s' || s END AS source, CASE form WHEN 0 THEN 'relative' WHEN 1 THEN 'package' ELSE 'dynamic' END AS type,
CASE form WHEN 0 THEN 'D' || p || '|b' || p || '|T' WHEN 1 THEN 'T' || p ELSE '' END AS specifiers, form = 2 AS is_dynamic, form = 1 AS is_type_only FROM c WHERE form < 3""")
def composed_imports(spark: SparkSession, d: str) -> DataFrame:
    return _composed(spark, d, "imports").withColumn("specifiers", F.array_join("specifiers", "|"))


@query(f"""WITH {_ITEMS} SELECT file_id, line, unnest(CASE form WHEN 3 THEN ['e' || p, 'Z' || p] WHEN 4 THEN ['* as n' || p] ELSE [substr('vfK', form::INTEGER - 4, 1) || p] END) AS name, CASE WHEN form < 5 THEN './s' || s END AS source,
false AS is_default, false AS is_anonymous, form = 4 AS is_type_only FROM c WHERE form BETWEEN 3 AND 7""")
def composed_exports(spark: SparkSession, d: str) -> DataFrame:
    return _composed(spark, d, "exports")


@query(f"""WITH {_ITEMS} SELECT file_id, 'K' || p AS name, 'class' AS type, 3 AS line_count, 0 AS jsx_depth, 'K' || p AS exports, '' AS hooks, '' AS props FROM c WHERE form = 7
UNION ALL SELECT file_id, 'P' || p, 'arrow', 1, 2, '', 'use' || s, '{{ q, r }}|ref' FROM c WHERE form = 8""")
def composed_components(spark: SparkSession, d: str) -> DataFrame:
    rows = _composed(spark, d, "components")
    return rows.select("file_id", "name", "type", "line_count", "jsx_depth", *(F.array_join(c, "|").alias(c) for c in ("exports", "hooks", "props")))


@query(f"""WITH {_ITEMS} SELECT file_id, 'useThing' || s AS name, line + 2 AS line, 10 AS "column", 'a|[1, {{ b: 2 }}]' AS arguments FROM c WHERE form = 6
UNION ALL SELECT file_id, 'use' || s, line, (39 + len(p))::INTEGER, 'q' FROM c WHERE form = 8
UNION ALL SELECT file_id, 'useEffect', line, 29, '() => {{ go' || s || '(`}} ${{w}}`); }}|[]' FROM c WHERE form = 9""")
def composed_hooks(spark: SparkSession, d: str) -> DataFrame:
    return _composed(spark, d, "hooks").select("file_id", "name", "line", "column", F.array_join("arguments", "|").alias("arguments"))


@query(f"""WITH {_ITEMS} SELECT file_id, CASE form WHEN 2 THEN 'm' WHEN 5 THEN 'v' WHEN 6 THEN 'f' WHEN 7 THEN 'K' ELSE 'P' END || p AS name, CASE form WHEN 6 THEN 'function' WHEN 7 THEN 'class' ELSE 'variable' END AS type, line FROM c WHERE form IN (2, 5, 6, 7, 8)
UNION ALL SELECT file_id, CASE form WHEN 6 THEN 'x' ELSE 'inner' END, 'variable', line + 1 FROM c WHERE form IN (6, 7)""")
def composed_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _composed(spark, d, "symbols").select("file_id", "name", "type", "line")


@query(f"""WITH {_ITEMS} SELECT file_id, 'src/o' || substr(file_id, 3) || '.tsx' AS path, sum((form < 3)::INT)::INTEGER AS n_imports, sum(CASE WHEN form = 3 THEN 2 WHEN form BETWEEN 4 AND 7 THEN 1 ELSE 0 END)::INTEGER AS n_exports,
sum((form = 6)::INT)::INTEGER AS function_count, sum(high)::INTEGER AS line_count, sha256(file_id || ':module') AS id FROM c GROUP BY file_id""")
def composed_modules(spark: SparkSession, d: str) -> DataFrame:
    return extract.modules(extract.extract(a.composed(spark, d), kinds=("imports", "exports", "module")))


@query(f"WITH s AS (SELECT {_FILE} AS file_id, 'src/p' || {_K} || '.tsx' AS path, unnest(['./p' || ({_K} + 1), './p' || ({_K} + 2), './p' || ({_K} + 1), './p' || ({_K} + 3)]) AS source, unnest([2, 7, 8, 9]) AS line FROM part) SELECT s.file_id, line, source, 'p:' || p_partkey AS target FROM s JOIN part ON source = './p' || p_partkey")
def extracted_links(spark: SparkSession, d: str) -> DataFrame:
    """Imports and re-exports, resolved to the files that they name."""
    facts = stored(extract.extract(a.sources(spark, d), kinds=("imports", "exports", "module")), "facts")
    modules = extract.modules(facts).select("id", "file_id", "path")
    statements = resolve.with_re_exports(extract.kind_of(facts, "imports"), extract.kind_of(facts, "exports"))
    done = resolve.resolve(statements, modules).where("target_id IS NOT NULL")
    return done.join(modules.select(F.col("id").alias("target_id"), F.col("file_id").alias("target")), "target_id").select("file_id", "line", "source", "target")


@query(f"SELECT {_FILE} AS file_id, 4 AS depth FROM part WHERE {_K} % 2 = 0 UNION ALL SELECT {_FILE}, 3 FROM part WHERE {_K} % 2 = 1")
def markup_depth(spark: SparkSession, d: str) -> DataFrame:
    """Of the panel's markup, in one more element for even parts."""
    inner = F.regexp_extract("text", r"return (<div>.*</div>);", 1)
    even = F.regexp_extract("file_id", r"(\d)$", 1).cast("int") % 2 == 0
    return a.sources(spark, d).select("file_id", nesting_depth(F.when(even, F.concat(F.lit("<main>"), inner, F.lit("</main>"))).otherwise(inner)).alias("depth"))


@query("""SELECT 'p:' || p_partkey AS file_id, unnest([{'path': '/shop/[id]', 'kind': 'next-app'}, {'path': '/', 'kind': 'next-app'}, {'path': '/a' || p_partkey, 'kind': 'next-pages'}, {'path': '/b', 'kind': 'next-pages'}], recursive := true) FROM part""")
def file_routes(spark: SparkSession, d: str) -> DataFrame:
    paths = F.explode(F.array(F.lit("app/shop/[id]/page.tsx"), F.lit("src/app/route.ts"), F.concat(F.lit("pages/a"), F.substr("file_id", F.lit(3)), F.lit("/index.tsx")), F.lit("pages/b.tsx"), F.lit("lib/x.ts")))
    files = a.sources(spark, d).select(F.col("file_id").alias("id"), paths.alias("path"))
    return extract.file_routes(files, "next").select("file_id", "path", "kind")


# --- rules on measures --------------------------------------------------------------------------------------------------------

_MEASURED = f"m AS (SELECT {_FILE} AS id, {_K} AS k, p_size AS n, 'src/g' || ({_K} % 40) || '/' || CASE WHEN {_K} % 3 = 0 THEN 'index.ts' ELSE 'p' || {_K} || '.ts' END AS path FROM part)"


def _sizes(spark: SparkSession, d: str, rule: str, **tables: DataFrame) -> DataFrame:
    return run_rule(spark, d, rule, files=a.measured_files(spark, d), **tables)


@query(f"WITH {_MEASURED} SELECT DISTINCT {told('barrel-file-overuse', 'warning', 'path', '1', 'said')} FROM (SELECT path, path || ' exports ' || n || ' symbols.' AS said FROM m WHERE k % 3 = 0 AND n > 30)")
def barrel_files(spark: SparkSession, d: str) -> DataFrame:
    return _sizes(spark, d, "barrel-file-overuse", modules=a.measured(spark, d))


@query(f"WITH {_MEASURED} SELECT DISTINCT {told('heavy-import-hub', 'warning', 'path', '1', 'said')} FROM (SELECT path, path || ' has ' || (n + k % 20) || ' imports.' AS said FROM m WHERE n + k % 20 > 50)")
def import_hubs(spark: SparkSession, d: str) -> DataFrame:
    return _sizes(spark, d, "heavy-import-hub", modules=a.measured(spark, d))


@query(f"WITH {_MEASURED} SELECT DISTINCT {told('excessive-export-count', 'warning', 'path', '1', 'said')} FROM (SELECT path, path || ' has ' || n || ' exports.' AS said FROM m WHERE n > 40)")
def export_counts(spark: SparkSession, d: str) -> DataFrame:
    return _sizes(spark, d, "excessive-export-count", modules=a.measured(spark, d))


@query(f"WITH {_MEASURED} SELECT {told('large-component', 'warning', 'path', '1', 'said')} FROM (SELECT path, 'C' || k || ' has ' || 10 * n || ' logical lines.' AS said FROM m WHERE 10 * n > 300)")
def large_components(spark: SparkSession, d: str) -> DataFrame:
    return _sizes(spark, d, "large-component", components=a.measured_components(spark, d))


@query(f"WITH {_MEASURED} SELECT {told('excessive-props', 'warning', 'path', '1', 'said')} FROM (SELECT path, 'C' || k || ' declares ' || (n % 15 + 1) || ' props.' AS said FROM m WHERE n % 15 + 1 > 10)")
def many_props(spark: SparkSession, d: str) -> DataFrame:
    return _sizes(spark, d, "excessive-props", components=a.measured_components(spark, d))


@query(f"WITH {_MEASURED} SELECT {told('deeply-nested-jsx', 'warning', 'path', '1', 'said')} FROM (SELECT path, 'C' || k || ' has JSX depth ' || (n % 12) || '.' AS said FROM m WHERE n % 12 > 8)")
def nested_markup(spark: SparkSession, d: str) -> DataFrame:
    return _sizes(spark, d, "deeply-nested-jsx", components=a.measured_components(spark, d))


@query(f"WITH {_MEASURED} SELECT {told('too-many-hooks', 'warning', 'path', '1', 'said')} FROM (SELECT path, 'C' || k || ' uses ' || (n % 20 + 1) || ' distinct hooks.' AS said FROM m WHERE n % 20 + 1 > 15)")
def many_hooks(spark: SparkSession, d: str) -> DataFrame:
    return _sizes(spark, d, "too-many-hooks", components=a.measured_components(spark, d))


# --- rules on the graph -------------------------------------------------------------------------------------------------------

_SUPPLY = "e AS (SELECT DISTINCT 'p:' || l_partkey AS source, 's:' || l_suppkey AS target FROM lineitem), f AS (SELECT source AS id, count(*) AS fan_out FROM e GROUP BY source), t AS (SELECT target AS id, count(*) AS fan_in FROM e GROUP BY target)"


def _fan(spark: SparkSession, d: str, rule: str) -> DataFrame:
    nodes = a.supply_nodes(spark, d)
    modules = nodes.select("id", F.col("id").alias("file_id"), "path")
    return run_rule(spark, d, rule, files=nodes.select("id", "path"), modules=modules, degrees=graph.degrees(nodes, graph.upsert_edges(a.supply_statements(spark, d))))


@query(f"WITH {_SUPPLY} SELECT {told('high-fan-out', 'warning', 'id', '1', 'said')} FROM (SELECT id, id || ' has ' || fan_out || ' outgoing dependencies.' AS said FROM f WHERE fan_out > 20)")
def rule_fan_out(spark: SparkSession, d: str) -> DataFrame:
    return _fan(spark, d, "high-fan-out")


@query(f"WITH {_SUPPLY} SELECT {told('high-fan-in', 'warning', 'id', '1', 'said')} FROM (SELECT id, id || ' has ' || fan_in || ' incoming dependencies.' AS said FROM t WHERE fan_in > 30)")
def rule_fan_in(spark: SparkSession, d: str) -> DataFrame:
    return _fan(spark, d, "high-fan-in")


@query(f"SELECT {told('deep-dependency-chain', 'warning', chr(39) + '.' + chr(39), '1', chr(39) + 'The maximum dependency depth is 3.' + chr(39))} FROM (SELECT count(*) AS n FROM orders) WHERE n > 0")
def deep_chains(spark: SparkSession, d: str) -> DataFrame:
    return run_rule(spark, d, "deep-dependency-chain", {"maxDepth": 2}, depth=graph.max_depth(a.key_edges(spark, d)))


_TRADE = """p AS (SELECT c_nationkey AS source, s_nationkey AS target, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
e AS (SELECT source, target FROM (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY n DESC, target) AS k FROM p) WHERE k = 1),
w AS (SELECT source AS start, target AS here, [source] AS path FROM e UNION ALL SELECT start, target, list_append(path, here) FROM w JOIN e ON here = source WHERE NOT list_contains(path, here)),
r AS (SELECT list_transform(path, lambda x: 'src/n' || lpad(x::VARCHAR, 2, '0') || '.ts') AS path FROM w WHERE here = start AND start = list_min(path))"""


@query(f"WITH RECURSIVE {_TRADE} SELECT {told('no-circular-imports', 'critical', 'file', '1', 'said')} FROM (SELECT path[1] AS file, 'Circular dependency: ' || array_to_string(list_append(path, path[1]), ' → ') || '.' AS said FROM r)")
def circular_imports(spark: SparkSession, d: str) -> DataFrame:
    name = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    edges = stored(a.trade(spark, d).select(F.lit("trade").alias("project"), name("source").alias("source"), name("target").alias("target")), "trade")
    ids = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    modules = ids.select("id", F.col("id").alias("file_id"), F.concat(F.lit("src/n"), "id", F.lit(".ts")).alias("path"))
    return run_rule(spark, d, "no-circular-imports", files=modules.select("id", "path"), modules=modules, nodes=modules, cycles=search.cycles(search.searched(edges)).drop("project"))


# --- the scan and the report --------------------------------------------------------------------------------------------------


@query("""SELECT path, sha256(path) AS id, extension, is_test, is_story FROM (SELECT CASE p_partkey % 8 WHEN 1 THEN 'src/p' || p_partkey || '.test.ts' WHEN 2 THEN 'src/p' || p_partkey || '.stories.tsx' WHEN 6 THEN 'src/P' || p_partkey || '.JSX' WHEN 7 THEN 'src/p' || p_partkey || '.spec.mjs' END AS path,
  CASE p_partkey % 8 WHEN 1 THEN '.ts' WHEN 2 THEN '.tsx' WHEN 6 THEN '.jsx' ELSE '.mjs' END AS extension, p_partkey % 8 IN (1, 7) AS is_test, p_partkey % 8 = 2 AS is_story FROM part WHERE p_partkey % 8 IN (1, 2, 6, 7))""")
def scan_of_tests_and_stories(spark: SparkSession, d: str) -> DataFrame:
    """Hidden and declaration files and packages' folders are passed by."""
    return project.scan(a.listing(spark, d), tests=True, stories=True).select("path", "id", "extension", "is_test", "is_story")


@query("SELECT 'src/P' || p_partkey || '.JSX' AS path FROM part WHERE p_partkey % 8 = 6 UNION ALL SELECT 'src/.p' || p_partkey || '.ts' FROM part WHERE p_partkey % 8 = 5 UNION ALL SELECT '.hidden/p' || p_partkey || '.ts' FROM part WHERE p_partkey % 8 = 0")
def scan_of_hidden_files(spark: SparkSession, d: str) -> DataFrame:
    return project.scan(a.listing(spark, d), include_hidden=True).select("path")


@query("SELECT count(*) AS total_files, count(*) FILTER (p_partkey % 8 IN (0, 5)) AS hidden_files, 0::BIGINT AS workspace_packages, count(*) FILTER (p_partkey % 8 = 6) AS source_files FROM part")
def scan_totals(spark: SparkSession, d: str) -> DataFrame:
    listing = a.listing(spark, d)
    return project.counters(listing, project.scan(listing)).select("total_files", "hidden_files", "workspace_packages", "source_files")


@query("SELECT p_partkey, 'a/b/' || p_partkey || '/c' AS path FROM part")
def normal_paths(spark: SparkSession, d: str) -> DataFrame:
    parts = a.table(spark, d, "part")
    return parts.select("p_partkey", normalized(F.concat(F.lit("a\\b//"), F.col("p_partkey").cast("string"), F.lit("///c"))).alias("path"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'src/' || p_partkey WHEN 3 THEN 'x/' || p_partkey ELSE '.' END AS path FROM part")
def published_paths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    said = F.when(k % 4 == 0, F.concat(F.lit("/top/src/"), k.cast("string"))).when(k % 4 == 1, F.lit("/elsewhere/x")).when(k % 4 == 2, F.lit("/top")).otherwise(F.concat(F.lit("x/"), k.cast("string")))
    return a.table(spark, d, "part").select("p_partkey", report.relative_path(said, "/top").alias("path"))


@query("SELECT p_partkey, 'depth=' || p_size || '|size=' || (p_size + 1) AS evidence FROM part")
def published_evidence(spark: SparkSession, d: str) -> DataFrame:
    one = lambda metric, value: F.struct(F.lit(metric).alias("metric"), value.cast("string").alias("value"))
    view = report.evidence_view(F.array(one("size", F.col("p_size") + 1), one("depth", F.col("p_size"))))
    return a.table(spark, d, "part").select("p_partkey", F.array_join(F.transform(view, lambda e: F.concat(e["metric"], F.lit("="), e["actual"])), "|").alias("evidence"))


@query("SELECT (SELECT count(*) FROM part) AS modules, (SELECT sum(p_size * 12) FROM part)::BIGINT AS lines_of_code, (SELECT count(*) FROM nation) AS packages")
def report_metrics(spark: SparkSession, d: str) -> DataFrame:
    return report.metrics(a.measured(spark, d), a.key_nodes(spark, d))
