"""The operators over the input tables, by name, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import half_up, ignore_glob, key, logical_lines, parent_steps, physical_lines, route_depth
from ..functions.metadata import cleaned, metadata
from ..functions.session import table
from ..operators import graph, invariants, policies, report, resolve, rules, search
from ..operators import score as scoring
from ..sources import project
from . import adapters as a
from . import source_queries  # noqa: F401  registers more
from .registry import ORACLES, QUERIES, query, run_rule, told  # noqa: F401


def _case(column: str, values: dict) -> str:
    said = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {said(v)}" for k, v in values.items()) + " END"


def _up(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


# --- findings and score -------------------------------------------------------------------------------------------------------

_RANK = {"critical": 0, "error": 1, "warning": 2, "info": 3}
_FINDINGS = f"""f AS (SELECT lpad(event_id::VARCHAR, 12, '0') AS id, event_id AS pos, {_case("event_type", a.RULE)} AS rule_id, {_case("event_type", a.CATEGORY)} AS category, {_case("event_type", a.SEVERITY)} AS severity,
  event_type || ' finding' AS title, event_type || ' ' || (event_id % 2) AS description, 'Review ' || event_type || ' ' || (event_id % 2) AS recommendation, 'user/' || user_id AS file, (event_id % 20 + 1)::INTEGER AS line FROM events)"""
_DEDUP = f"""{_FINDINGS}, u AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, file, line, description ORDER BY pos) AS k FROM f) WHERE k = 1)"""
_WEIGHT, _CAP = _case("rule_id", scoring.RULE_WEIGHTS).replace(" END", " ELSE 1.0 END"), _case("rule_id", scoring.RULE_CAPS).replace(" END", " ELSE 30.0 END")
_DEDUCT = f"""{_DEDUP}, k AS (SELECT *, row_number() OVER (PARTITION BY rule_id, category ORDER BY {_case("severity", _RANK)}, id) AS n FROM u),
d AS (SELECT rule_id, category, count(*)::BIGINT AS finding_count, {_up(f"least(any_value({_CAP})::DOUBLE, sum({_case('severity', scoring.PENALTIES)}::DOUBLE / n) * any_value({_WEIGHT})::DOUBLE)")} AS penalty, any_value({_WEIGHT})::DOUBLE AS weight, arg_min(title, pos) AS reason FROM k GROUP BY rule_id, category)"""
_CATEGORIES = f"""{_DEDUCT}, w(category, weight) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in scoring.ScoreConfig().weights().items())}),
c AS (SELECT w.category, {_up("coalesce(sum(penalty), 0)")} AS penalty, {_up("greatest(0, least(100, 100 - coalesce(sum(penalty), 0)))")} AS score, w.weight FROM w LEFT JOIN d USING (category) GROUP BY w.category, w.weight)"""
_COUNTS = """n AS (SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info, count(*) AS total FROM u)"""
_BURDEN = _up("least(8, sqrt(warning) * 1.1) + least(2, sqrt(info) * 0.08) + least(6, error * 1.5)")
_CRITICAL = "([0, 10, 18, 24, 28]::DOUBLE[])[least(critical, 4) + 1]"
_GRADE = "CASE " + " ".join(f"WHEN {{0}} >= {n} THEN '{g}'" for n, g in scoring.GRADES) + " ELSE 'F' END"
_TOTAL = f"""{_CATEGORIES}, {_COUNTS}, t AS (SELECT *, {_up("greatest(0, least(100, weighted - burden - critical_risk))")} AS overall FROM (SELECT (SELECT {_up("sum(score * (weight / 100))")} FROM c) AS weighted, *, {_BURDEN} AS burden, {_CRITICAL} AS critical_risk FROM n))"""


@query(f"WITH {_TOTAL} SELECT weighted, critical, error, warning, info, total, burden, critical_risk, overall, {_GRADE.format('overall')} AS grade FROM t")
def score_overall(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score(a.findings(spark, d)).total


@query(f"WITH {_DEDUP} SELECT id, pos, rule_id, category, severity, title, description, recommendation, file, line, 1 AS \"column\" FROM u")
def findings_dedup(spark: SparkSession, d: str) -> DataFrame:
    return scoring.dedup(a.findings(spark, d))


@query(f"WITH {_DEDUCT} SELECT * FROM d")
def score_deductions(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score(a.findings(spark, d)).deductions


@query(f"WITH {_CATEGORIES} SELECT * FROM c")
def score_categories(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score(a.findings(spark, d)).categories


@query(f"""WITH {_TOTAL}, x AS (SELECT upper(category[1]) || category[2:] || ' category' AS label, 'category' AS type, {_up("penalty * (weight / 100)")} AS impact FROM c
UNION ALL SELECT 'Maintenance burden', 'maintenance-burden', burden FROM t UNION ALL SELECT 'Critical-risk adjustment', 'critical-risk', critical_risk FROM t) SELECT * FROM x WHERE impact > 0""")
def score_contributors(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score(a.findings(spark, d)).contributors.drop("detail")


@query(f"WITH {_TOTAL} SELECT (SELECT count(*) FILTER (score >= 90) FROM c) AS healthy, array_to_string((SELECT list(category || ' needs attention.' ORDER BY category) FROM c WHERE score < 75), '|') AS weaknesses FROM t")
def score_explanation(spark: SparkSession, d: str) -> DataFrame:
    s = scoring.score(a.findings(spark, d))
    said = scoring.explanation(s.categories, s.total, 1, 1).select(F.array_join("weaknesses", "|").alias("weaknesses"))
    return s.categories.agg(F.count_if(F.col("score") >= 90).alias("healthy")).crossJoin(said)


@query(f"SELECT c_custkey, x AS score, {_GRADE.format('x')} AS grade FROM (SELECT c_custkey, {_up('greatest(0, least(100, c_acctbal / 100))')} AS x FROM customer)")
def grade_bands(spark: SparkSession, d: str) -> DataFrame:
    score = half_up(F.least(F.greatest(F.col("c_acctbal") / 100, F.lit(0.0)), F.lit(100.0)))
    return table(spark, d, "customer").select("c_custkey", score.alias("score"), scoring.grade(score).alias("grade"))


_BY_FILE = f"WITH {_FINDINGS}, n AS (SELECT file, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info, count(*) AS total FROM f GROUP BY file)"


def _by_file(spark: SparkSession, d: str) -> DataFrame:
    return a.findings(spark, d).groupBy("file").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in scoring.SEVERITIES), F.count(F.lit(1)).alias("total"))


@query(f"{_BY_FILE} SELECT file, {_BURDEN} AS burden FROM n")
def maintenance_burden(spark: SparkSession, d: str) -> DataFrame:
    return _by_file(spark, d).select("file", scoring.maintenance_burden(F.col("warning"), F.col("info"), F.col("error")).alias("burden"))


@query(f"{_BY_FILE} SELECT file, {_CRITICAL} AS adjustment FROM n")
def critical_adjustment(spark: SparkSession, d: str) -> DataFrame:
    return _by_file(spark, d).select("file", scoring.critical_adjustment(F.col("critical")).alias("adjustment"))


@query(f"{_BY_FILE} SELECT file, greatest(0, least(100, 100 - 5 * critical))::DOUBLE AS confidence, {_up('total / greatest(1, sqrt(greatest(1, warning * 50) / 100))')} AS normalized FROM n")
def confidence_and_normalized_count(spark: SparkSession, d: str) -> DataFrame:
    return _by_file(spark, d).select("file", scoring.confidence(F.col("critical")).alias("confidence"), scoring.normalized_count(F.col("total"), F.col("warning") * 50).alias("normalized"))


@query(f"WITH {_FINDINGS} SELECT severity, count(*) AS n FROM f GROUP BY severity")
def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = scoring.severity_counts(a.findings(spark, d))
    return counts.select(F.expr("stack(4, 'critical', critical, 'error', error, 'warning', warning, 'info', info) AS (severity, n)"))


_ORDER = f"{_case('severity', _RANK)}, rule_id, file, line, id"


@query(f"WITH {_FINDINGS} SELECT id, rule_id, severity, file, line FROM f WHERE severity = 'critical' ORDER BY {_ORDER} LIMIT 250")
def findings_page(spark: SparkSession, d: str) -> DataFrame:
    return report.findings_page(a.findings(spark, d), "critical").select("id", "rule_id", "severity", "file", "line")


@query(f"WITH {_FINDINGS} SELECT id, rule_id, severity FROM f WHERE severity <> 'info' ORDER BY {_ORDER} LIMIT 3")
def top_priorities(spark: SparkSession, d: str) -> DataFrame:
    return report.top_priorities(a.findings(spark, d)).select("id", "rule_id", "severity")


@query(f"WITH {_FINDINGS}, o AS (SELECT recommendation, row_number() OVER (ORDER BY {_ORDER}) AS r FROM f) SELECT recommendation, row_number() OVER (ORDER BY min(r)) AS rank FROM o GROUP BY recommendation ORDER BY min(r) LIMIT 3")
def top_recommendations(spark: SparkSession, d: str) -> DataFrame:
    return report.top_recommendations(a.findings(spark, d))


@query(f"WITH {_FINDINGS} SELECT title, count(*) AS n FROM f WHERE severity IN ('critical', 'error') GROUP BY title")
def risks(spark: SparkSession, d: str) -> DataFrame:
    return report.risks(a.findings(spark, d))


_SPOTS = f"""{_CATEGORIES}, e AS (SELECT rule_id, d.category, d.penalty / finding_count * (c.weight / 100) AS each FROM d JOIN c USING (category)),
h AS (SELECT file, count(*)::BIGINT AS finding_count, sum({_case("severity", report.PRIORITY)})::BIGINT AS priority_score, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info,
  arg_min(recommendation, ({_case("severity", _RANK)}, rule_id, line, id)) AS recommendation, {_up("sum(coalesce(each, 0))")} AS estimated_recovery FROM f LEFT JOIN e USING (rule_id, category) GROUP BY file),
q AS (SELECT * FROM h WHERE file IN (SELECT file FROM f WHERE rule_id IN ('duplicate-imports', 'orphan-module', 'unused-export')) ORDER BY priority_score DESC, finding_count DESC, file LIMIT 5)"""


def _spots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found = a.findings(spark, d)
    s = scoring.score(found)
    return found, report.hotspots(found, s.deductions, s.categories)


@query(f"WITH {_SPOTS} SELECT * FROM h")
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    return _spots(spark, d)[1]


@query(f"WITH {_SPOTS} SELECT file, priority_score FROM h ORDER BY priority_score DESC, finding_count DESC, file LIMIT 8")
def top_hotspots(spark: SparkSession, d: str) -> DataFrame:
    return report.top_hotspots(_spots(spark, d)[1]).select("file", "priority_score")


@query(f"WITH {_SPOTS} SELECT file, finding_count, recommendation, estimated_recovery FROM q")
def quick_wins(spark: SparkSession, d: str) -> DataFrame:
    found, spots = _spots(spark, d)
    return report.quick_wins(spots, found).select("file", "finding_count", "recommendation", "estimated_recovery")


@query(f"WITH {_SPOTS} SELECT file, finding_count, recommendation, estimated_recovery FROM h WHERE file NOT IN (SELECT file FROM q) ORDER BY priority_score DESC, finding_count DESC, file LIMIT 3")
def roadmap(spark: SparkSession, d: str) -> DataFrame:
    found, spots = _spots(spark, d)
    return report.roadmap(spots, report.quick_wins(spots, found)).select("file", "finding_count", "recommendation", "estimated_recovery")


_HISTORY = f"h AS (SELECT strftime(ts, '%Y-%m-%d') AS generated_at, {_up('100 - 100.0::DOUBLE * count(*) FILTER (event_type = ' + chr(39) + 'error' + chr(39) + ') / count(*)')} AS overall FROM events GROUP BY 1)"


@query(f"WITH {_HISTORY}, l AS (SELECT * FROM h ORDER BY generated_at DESC LIMIT 8) SELECT generated_at, overall, {_up('overall - lag(overall) OVER (ORDER BY generated_at)')} AS delta FROM l")
def history_timeline(spark: SparkSession, d: str) -> DataFrame:
    return report.timeline(a.history(spark, d))


@query(f"WITH {_HISTORY} SELECT generated_at, CASE WHEN overall >= 82 THEN 'top-quartile' WHEN overall >= 80 THEN 'above-median' WHEN overall >= 78 THEN 'middle-half' ELSE 'below-median' END AS band FROM h")
def benchmark_bands(spark: SparkSession, d: str) -> DataFrame:
    return a.history(spark, d).select("generated_at", report.benchmark_band(F.col("overall"), F.lit(78.0), F.lit(80.0), F.lit(82.0)).alias("band"))


# --- graph --------------------------------------------------------------------------------------------------------------------

_STATEMENTS = "s AS (SELECT 'p:' || l_partkey AS source, 's:' || l_suppkey AS target, l_returnflag = 'R' AS is_dynamic, l_shipdate FROM lineitem)"
_SUPPLY = f"{_STATEMENTS}, e AS (SELECT source, target, bool_or(is_dynamic) AS is_dynamic FROM s GROUP BY source, target), n AS (SELECT 'p:' || p_partkey AS id FROM part UNION ALL SELECT 's:' || s_suppkey FROM supplier)"
_KEYS = """e AS (SELECT 'o:' || o_orderkey AS source, 'c:' || o_custkey AS target FROM orders UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey FROM customer UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation),
n AS (SELECT 'o:' || o_orderkey AS id, 'orders' AS label, 'src/orders/' || o_orderkey AS path, 'module' AS type FROM orders UNION ALL SELECT 'c:' || c_custkey, 'customer', 'src/customer/' || c_custkey, 'module' FROM customer UNION ALL SELECT 'n:' || n_nationkey, 'nation', 'src/nation/' || n_nationkey, 'package' FROM nation UNION ALL SELECT 'r:' || r_regionkey, 'region', 'src/region/' || r_regionkey, 'missing' FROM region)"""
_DEGREES = "g AS (SELECT n.id, (SELECT count(*) FROM e WHERE e.target = n.id) AS fan_in, (SELECT count(*) FROM e WHERE e.source = n.id) AS fan_out FROM n)"


def _supply(spark: SparkSession, d: str) -> DataFrame:
    return graph.upsert_edges(a.supply_statements(spark, d))


@query(f"WITH {_SUPPLY} SELECT source, target, is_dynamic, false AS is_broken, false AS is_external, sha256('edge:' || source || ':' || target) AS id FROM e")
def edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    return _supply(spark, d)


@query(f"WITH {_KEYS} SELECT * FROM n")
def node_union(spark: SparkSession, d: str) -> DataFrame:
    nodes = a.key_nodes(spark, d)
    return graph.node_union(nodes.where("type = 'module'"), nodes)


@query("""WITH i AS (SELECT 'files' AS family, o_orderkey::VARCHAR AS id FROM orders UNION ALL SELECT 'nodes', l_orderkey::VARCHAR FROM lineitem UNION ALL SELECT 'findings', l_orderkey || ':' || l_linenumber FROM lineitem)
SELECT 'duplicate id' AS code, family, id, count(*) AS times FROM i GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'path not normal', 'files', o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN '//' ELSE '/' END || o_orderkey, 1 FROM orders WHERE o_orderkey % 3 = 0""")
def report_problems(spark: SparkSession, d: str) -> DataFrame:
    """Orders as files, some with a path that isn't normal, and lines as nodes, named by their order alone, and as findings."""
    lines, k = table(spark, d, "lineitem"), F.col("o_orderkey")
    files = table(spark, d, "orders").select(k.alias("id"), F.concat("o_orderpriority", F.when(k % 3 == 0, "//").otherwise("/"), k.cast("string")).alias("path"))
    return invariants.problems({"files": files, "nodes": lines.select(F.col("l_orderkey").alias("id")), "findings": lines.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"))})


@query("SELECT c_custkey AS id, to_json({list: [to_json({kept: c_nationkey}), to_json([c_custkey])]::JSON[], name: c_name, nested: {deep: {}::MAP(VARCHAR, INT), kept: c_acctbal > 0}}) AS metadata FROM customer")
def published_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Names that are never published are gone at every depth, in arrays too."""
    c = F.col
    said = lambda v: F.to_json(v, {"ignoreNullFields": "false"})
    quoted = lambda v: F.coalesce(F.to_json(v.cast("variant")), F.lit("null"))
    inner = F.struct(F.struct(c("c_mktsegment").alias("apiKey")).alias("deep"), (c("c_acctbal") > 0).alias("kept"), c("c_name").alias("accessToken"))
    item, other = F.struct(c("c_nationkey").alias("kept"), c("c_name").alias("password")), F.array("c_custkey")
    rows = table(spark, d, "customer").select(c("c_custkey").alias("id"), said(item).alias("item"), said(other).alias("other"), said(inner).alias("nested"), quoted(c("c_name")).alias("name"))
    text = F.concat(F.lit('{"name":'), c("name"), F.lit(',"userName":'), c("name"), F.lit(',"list":['), c("item"), F.lit(","), c("other"), F.lit('],"cookies":{"kept":1},"nested":'), c("nested"), F.lit("}"))
    return rows.select("id", F.to_json(cleaned(F.parse_json(text))).alias("metadata"))


@query("SELECT p_partkey AS id, to_json({functionCount: p_size, lineCount: len(p_name)}) AS metadata FROM part WHERE p_name IS NOT NULL AND p_size IS NOT NULL")
def node_metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").where("p_name IS NOT NULL AND p_size IS NOT NULL")
    return rows.select(F.col("p_partkey").alias("id"), F.to_json(metadata(functionCount=F.col("p_size"), lineCount=F.length("p_name"), fileId=F.lit(None).cast("string"))).alias("metadata"))


@query(f"WITH {_SUPPLY}, {_DEGREES} SELECT id, fan_in, fan_out FROM g")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(a.supply_nodes(spark, d), _supply(spark, d))


@query(f"WITH {_SUPPLY}, {_DEGREES} SELECT id, fan_out FROM g WHERE fan_out > 20")
def high_fan_out(spark: SparkSession, d: str) -> DataFrame:
    return degrees(spark, d).where("fan_out > 20").select("id", "fan_out")


@query(f"WITH {_SUPPLY}, {_DEGREES} SELECT id, fan_in FROM g WHERE fan_in > 30")
def high_fan_in(spark: SparkSession, d: str) -> DataFrame:
    return degrees(spark, d).where("fan_in > 30").select("id", "fan_in")


@query(f"WITH {_SUPPLY} SELECT source AS id, string_agg(target, ',' ORDER BY target) AS children FROM e GROUP BY source")
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(_supply(spark, d)).where("children IS NOT NULL").select("id", F.array_join("children", ",").alias("children"))


@query(f"WITH {_STATEMENTS} SELECT id FROM (SELECT 'p:' || p_partkey AS id FROM part) WHERE id NOT IN (SELECT source FROM s WHERE year(l_shipdate) = 1995)")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    edges = a.supply_statements(spark, d).where(F.year("l_shipdate") == 1995)
    return graph.orphans(a.supply_nodes(spark, d).where(F.col("id").startswith("p:")), edges).select("id")


@query(f"WITH {_KEYS} SELECT (SELECT count(*) - count(DISTINCT id) FROM n)::BIGINT AS duplicate_nodes, (SELECT count(*) - count(DISTINCT (source, target)) FROM e)::BIGINT AS duplicate_edges, (SELECT count(*) FROM e WHERE source NOT IN (SELECT id FROM n) OR target NOT IN (SELECT id FROM n)) AS dangling_edges")
def integrity(spark: SparkSession, d: str) -> DataFrame:
    return graph.integrity(a.key_nodes(spark, d), a.key_edges(spark, d))


@query(f"WITH {_KEYS} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM n WHERE id NOT IN (SELECT source FROM e) AND id NOT IN (SELECT target FROM e)) AS orphans, (SELECT count(*) FROM region) AS components, (SELECT count(*) FROM e) / (SELECT count(*) FROM n) AS average_fan_in, (SELECT count(*) FROM e) / (SELECT count(*) FROM n) AS average_fan_out")
def graph_statistics(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = a.key_nodes(spark, d), a.key_edges(spark, d)
    return graph.statistics(nodes, edges, graph.weak_components(nodes, edges))


@query(f"WITH RECURSIVE {_KEYS}, x AS (SELECT id, id AS root FROM n WHERE id LIKE 'r:%' UNION SELECT e.source, x.root FROM x JOIN e ON e.target = x.id), m AS (SELECT root, min(id) AS component FROM x GROUP BY root) SELECT x.id, m.component FROM x JOIN m USING (root)")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.weak_components(a.key_nodes(spark, d), a.key_edges(spark, d))


@query(f"WITH RECURSIVE {_KEYS}, x AS (SELECT target AS id FROM e WHERE source = 'o:1' UNION SELECT e.target FROM x JOIN e ON e.source = x.id) SELECT id FROM x")
def reachable_from(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable(a.key_edges(spark, d), "o:1")


@query(f"WITH RECURSIVE {_KEYS}, x AS (SELECT source AS id FROM e WHERE target = 'r:2' UNION SELECT e.source FROM x JOIN e ON e.target = x.id) SELECT id FROM x")
def dependents_of(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable(a.key_edges(spark, d), "r:2", backward=True)


@query(f"WITH {_KEYS} SELECT source AS id FROM e WHERE target = 'n:3'")
def parents_of(spark: SparkSession, d: str) -> DataFrame:
    return graph.parents(a.key_edges(spark, d), "n:3")


@query(f"WITH RECURSIVE {_KEYS}, x AS (SELECT 0 AS step, 'o:7' AS id UNION ALL SELECT step + 1, e.target FROM x JOIN e ON e.source = x.id) SELECT step, id FROM x WHERE step <= 2")
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    edges = a.key_edges(spark, d)
    end = edges.where("source = 'o:7'").select(F.col("target").alias("source")).join(edges, "source").first()["target"]
    return graph.shortest_path(edges, "o:7", end)


@query(f"WITH RECURSIVE {_KEYS}, x AS (SELECT DISTINCT source AS id, 0 AS depth FROM e UNION SELECT e.target, depth + 1 FROM x JOIN e ON e.source = x.id) SELECT id, max(depth)::INTEGER AS depth FROM x GROUP BY id")
def depths(spark: SparkSession, d: str) -> DataFrame:
    return graph.depths(a.key_edges(spark, d))


@query(f"WITH RECURSIVE {_KEYS}, x AS (SELECT DISTINCT source AS id, 0 AS depth FROM e UNION SELECT e.target, depth + 1 FROM x JOIN e ON e.source = x.id) SELECT max(depth)::INTEGER AS max_depth FROM x")
def max_depth(spark: SparkSession, d: str) -> DataFrame:
    return graph.max_depth(a.key_edges(spark, d))


_TRADE = """p AS (SELECT c_nationkey AS source, s_nationkey AS target, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
e AS (SELECT source, target FROM (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY n DESC, target) AS k FROM p) WHERE k = 1)"""
_RINGS = f"""{_TRADE}, w AS (SELECT source AS start, target AS here, [source] AS path FROM e UNION ALL SELECT start, target, list_append(path, here) FROM w JOIN e ON here = source WHERE NOT list_contains(path, here)),
r AS (SELECT path FROM w WHERE here = start AND start = list_min(path))"""


@query(f"WITH RECURSIVE {_RINGS} SELECT array_to_string(path, ',') AS cycle, len(path)::INTEGER AS length FROM r")
def cycles_functional(spark: SparkSession, d: str) -> DataFrame:
    return graph.functional_cycles(a.trade(spark, d)).select(F.array_join("cycle", ",").alias("cycle"), "length")


@query(f"WITH RECURSIVE {_RINGS} SELECT unnest(path)::BIGINT AS id, list_min(path)::BIGINT AS component FROM r")
def strong_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.strong_components(a.trade(spark, d))


@query(f"WITH RECURSIVE {_RINGS} SELECT len(path)::INTEGER AS length, array_to_string(path, ',') AS nodes FROM r")
def cycles_searched(spark: SparkSession, d: str) -> DataFrame:
    """The depth-first search, turned so that the least number leads."""
    pairs = a.trade(spark, d).select(F.lit("trade").alias("project"), *(F.lpad(F.col(c).cast("string"), 2, "0").alias(c) for c in ("source", "target")))
    found = search.cycles(search.searched(pairs))
    return found.select("length", F.array_join(F.transform(graph.canonical(F.col("nodes")), lambda x: x.cast("int").cast("string")), ",").alias("nodes"))


_RING = """r AS (SELECT c_nationkey AS k, c_custkey AS c, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
t AS (SELECT s_suppkey AS s, s_suppkey % 2 = 0 AS early, r.* FROM supplier JOIN r ON r.k = s_nationkey AND r.i = s_suppkey % r.n),
f AS (SELECT k, any_value(n) AS n, coalesce((SELECT arg_min(i, s) FROM t WHERE t.k = r.k AND early), 0) AS i0 FROM r GROUP BY k),
x AS (SELECT r.k, 'm' || lpad(c::VARCHAR, 9, '0') AS id, CASE WHEN r.n = 1 THEN 1 ELSE r.n - (i - i0 + r.n) % r.n END AS depth FROM r JOIN f USING (k)
  UNION ALL SELECT t.k, CASE WHEN early THEN 'a' ELSE 'z' END || lpad(s::VARCHAR, 9, '0'), 1 + CASE WHEN t.n = 1 THEN 1 ELSE t.n - (i - i0 + t.n) % t.n END FROM t JOIN f USING (k))"""


def _rings(spark: SparkSession, d: str) -> DataFrame:
    """A graph for each nation: its customers in a ring, its suppliers, of which some come before all customers, leading into it."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")  # of one nation's customers
    own = table(spark, d, "customer").where("c_nationkey IS NOT NULL").select("c_nationkey", "c_custkey")
    ring = own.select(F.col("c_nationkey").alias("project"), F.concat(F.lit("m"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("id"), (F.row_number().over(w) - 1).alias("at"))
    ring = ring.join(own.groupBy(F.col("c_nationkey").alias("project")).agg(F.count(F.lit(1)).alias("n")), "project")
    to = ring.select("project", "at", F.col("id").alias("target"))
    steps = ring.select("project", ((F.col("at") + 1) % F.col("n")).alias("at"), F.col("id").alias("source")).join(to, ["project", "at"])
    tails = table(spark, d, "supplier").select(F.col("s_nationkey").alias("project"), "s_suppkey").join(ring.select("project", "n").distinct(), "project")
    name = F.concat(F.when(F.col("s_suppkey") % 2 == 0, F.lit("a")).otherwise(F.lit("z")), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))
    tails = tails.select("project", (F.col("s_suppkey") % F.col("n")).alias("at"), name.alias("source")).join(to, ["project", "at"])
    return steps.unionByName(tails).select("project", "source", "target")


@query(f"WITH {_RING} SELECT k::VARCHAR AS project, id, depth::INTEGER AS depth FROM x")
def search_depths(spark: SparkSession, d: str) -> DataFrame:
    """Depths on cycles, which depend on where the search comes in; each graph in one task."""
    return search.depths(search.searched(_rings(spark, d)))


@query(f"WITH {_RING} SELECT k::VARCHAR AS project, id, depth::INTEGER AS depth FROM x")
def search_depths_apart(spark: SparkSession, d: str) -> DataFrame:
    """The same with every graph taken apart into its strong components."""
    return search.depths(search.searched(_rings(spark, d), most=0))


@query(f"WITH {_RING} SELECT k::VARCHAR AS project, max(depth)::INTEGER AS max_depth, count(*) FILTER (id LIKE 'm%') AS length FROM x GROUP BY k")
def search_cycles(spark: SparkSession, d: str) -> DataFrame:
    """One cycle for each graph, as long as its ring; and how deep the search goes."""
    found = search.searched(_rings(spark, d), most=1000)
    return search.depths(found).groupBy("project").agg(F.max("depth").alias("max_depth")).join(search.cycles(found).select("project", F.col("length").cast("long")), "project")


@query(f"""WITH {_KEYS}, g AS (SELECT id, CASE type WHEN 'package' THEN 'packages' WHEN 'missing' THEN 'missing' ELSE 'src/' || label END AS g FROM n)
SELECT s.g AS source_group, t.g AS target_group, count(*) AS n FROM e JOIN g s ON e.source = s.id JOIN g t ON e.target = t.id WHERE s.g <> t.g GROUP BY ALL""")
def group_edges(spark: SparkSession, d: str) -> DataFrame:
    groups = a.key_nodes(spark, d).select("id", graph.node_group(F.col("path"), F.col("type")).alias("group"))
    return graph.group_edges(a.key_edges(spark, d), groups)


# --- resolution, policies, rules ----------------------------------------------------------------------------------------------

_MODULES = "m AS (SELECT doc_id::VARCHAR AS id, doc_id, source AS s, lang AS l, 'src/' || source || '/' || lang || '/m' || doc_id || '.ts' AS path FROM documents)"
_RESOLVED = f"""{_MODULES}, r AS (
  SELECT a.id AS file_id, 1 AS line, './../' || a.l || '/./m' || (a.doc_id + 20) AS source, 'relative' AS type, a.path AS source_path, b.id AS target_id, b.path AS target_path FROM m a LEFT JOIN m b ON b.path = 'src/' || a.s || '/' || a.l || '/m' || (a.doc_id + 20) || '.ts'
  UNION ALL SELECT a.id, 2, '@/' || a.s || '/' || a.l || '/m' || (a.doc_id + 20), 'package', a.path, b.id, b.path FROM m a LEFT JOIN m b ON b.path = 'src/' || a.s || '/' || a.l || '/m' || (a.doc_id + 20) || '.ts'
  UNION ALL SELECT id, 3, 'pkg' || (doc_id % 7), 'package', path, NULL, NULL FROM m)"""
_POLICIES = policies.configure(
    {
        "policies": [
            {"id": "english-alone", "description": "English modules use English modules.", "from": ["src/*/en/**"], "allow": ["src/*/en/**"], "severity": "warning"},
            {"id": "no-first-source", "description": "Nobody uses the first source's French.", "from": ["src/**"], "disallow": ["src/src0/fr/**", "src/src1/*/m1*.ts"], "severity": "error"},
            {"id": "quiet", "description": "Never broken.", "from": ["lib/**"], "disallow": ["src/**"], "severity": "info"},
        ]
    }
)
_BROKEN = f"""{_RESOLVED}, v AS (SELECT r.*, p FROM r, (VALUES ('english-alone'), ('no-first-source'), ('quiet')) t(p) WHERE target_path IS NOT NULL AND (
  p = 'english-alone' AND regexp_full_match(source_path, 'src/[^/]*/en/.*') AND NOT regexp_full_match(target_path, 'src/[^/]*/en/.*')
  OR p = 'no-first-source' AND (regexp_full_match(target_path, 'src/src0/fr/.*') OR regexp_full_match(target_path, 'src/src1/[^/]*/m1[^/]*\\.ts'))))"""


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve(a.imports(spark, d), a.modules(spark, d))


@query(f"WITH {_RESOLVED} SELECT file_id, line, source, source_path, target_id, target_path FROM r")
def resolve_imports(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).select("file_id", "line", "source", "source_path", "target_id", "target_path")


@query(f"""WITH {_RESOLVED} SELECT file_id, line, CASE WHEN target_id IS NOT NULL THEN 'module' WHEN type = 'relative' THEN 'missing' ELSE 'package' END AS target_type,
  CASE WHEN target_id IS NOT NULL THEN target_id WHEN type = 'relative' THEN sha256('missing:' || source_path || ':' || source) ELSE sha256('package:' || source) END AS target FROM r""")
def classify_targets(spark: SparkSession, d: str) -> DataFrame:
    return resolve.classify(_resolved(spark, d)).select("file_id", "line", "target_type", "target")


def _broken(spark: SparkSession, d: str) -> DataFrame:
    done = policies.resolved_imports(a.imports(spark, d), a.exports(spark, d), a.modules(spark, d), a.files(spark, d))
    return policies.violations(done, _POLICIES)


@query(f"WITH {_BROKEN} SELECT sha256('architecture-policy:' || p || ':' || source_path || ':' || line || ':' || target_path) AS id, source_path AS file, line, 'Policy violation: ' || p AS title, source_path || ' imports ' || target_path || ', which violates policy ' || p || '.' AS description FROM v")
def policy_violations(spark: SparkSession, d: str) -> DataFrame:
    return policies.findings(_broken(spark, d), _POLICIES).select("id", "file", "line", "title", "description")


@query(f"WITH {_BROKEN} SELECT t.p AS id, CASE WHEN count(v.p) > 0 THEN 'failed' ELSE 'passed' END AS status, count(v.p) AS violation_count, count(DISTINCT source_path) AS files FROM (VALUES ('english-alone'), ('no-first-source'), ('quiet')) t(p) LEFT JOIN v ON v.p = t.p GROUP BY t.p")
def policy_evaluations(spark: SparkSession, d: str) -> DataFrame:
    return policies.evaluations(_broken(spark, d), _POLICIES).select("id", "status", "violation_count", F.size("files").cast("long").alias("files"))


_LINKS = "i AS (SELECT page_id::VARCHAR AS file_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS source FROM pages)"


@query(f"WITH {_LINKS}, {_MODULES} SELECT DISTINCT {told('duplicate-imports', 'warning', 'file', '1', 'said')} FROM (SELECT coalesce(path, '.') AS file, 'The module imports ' || source || ' ' || count(*) || ' times.' AS said FROM i LEFT JOIN m ON m.id = i.file_id GROUP BY file_id, path, source HAVING count(*) >= 2)")
def duplicate_imports(spark: SparkSession, d: str) -> DataFrame:
    return run_rule(spark, d, "duplicate-imports", imports=a.page_imports(spark, d))


@query(f"WITH {_MODULES}, x AS (SELECT m.path, d.doc_id, split_part(replace(text, chr(10), ' '), ' ', 1) AS name FROM documents d JOIN m USING (doc_id)) SELECT DISTINCT {told('unused-export', 'info', 'path', '1', 'said')} FROM (SELECT path, name || ' is not imported by another scanned module.' AS said FROM x WHERE doc_id % 5 <> 0 AND name NOT IN ('default', '*') AND name NOT IN (SELECT ltrim(source, '/') FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS source FROM pages)))")
def unused_exports(spark: SparkSession, d: str) -> DataFrame:
    named = a.page_imports(spark, d).select("file_id", "source", F.array(F.ltrim(F.col("source"), F.lit("/"))).alias("specifiers"))
    return run_rule(spark, d, "unused-export", imports=named, exports=a.exports(spark, d))


@query(f"WITH {_MODULES} SELECT {told('anonymous-default-export', 'warning', 'path', '1', chr(39) + 'A default export has no stable symbol name.' + chr(39))} FROM m WHERE doc_id % 10 = 0")
def anonymous_exports(spark: SparkSession, d: str) -> DataFrame:
    return run_rule(spark, d, "anonymous-default-export", exports=a.exports(spark, d))


@query(f"WITH {_MODULES} SELECT {told('oversized-module', 'warning', 'path', '1', 'said')} FROM (SELECT path, path || ' has ' || n || ' logical lines.' AS said FROM (SELECT path, len(string_split(text, chr(10))) AS n FROM m JOIN documents USING (doc_id)) WHERE n > 15)")
def oversized_modules(spark: SparkSession, d: str) -> DataFrame:
    return run_rule(spark, d, "oversized-module", {"maxLines": 15}, modules=a.modules(spark, d))


@query(f"WITH {_MODULES} SELECT {told('excessive-file-count', 'warning', chr(39) + '.' + chr(39), '1', 'said')} FROM (SELECT 'src/' || s || '/' || l || ' contains ' || count(*) || ' files.' AS said FROM m GROUP BY s, l HAVING count(*) > 10)")
def excessive_files(spark: SparkSession, d: str) -> DataFrame:
    return run_rule(spark, d, "excessive-file-count", {"maxFiles": 10})


@query(f"WITH {_MODULES}, x AS (SELECT page_id::VARCHAR AS id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS route FROM pages) SELECT DISTINCT {told('deeply-nested-routes', 'warning', 'file', '1', 'said')} FROM (SELECT coalesce(path, '.') AS file, route || ' has ' || len(list_filter(string_split(route, '/'), lambda p: p <> '')) || ' route levels.' AS said FROM x LEFT JOIN m USING (id) WHERE len(list_filter(string_split(route, '/'), lambda p: p <> '')) > 1)")
def nested_routes(spark: SparkSession, d: str) -> DataFrame:
    return run_rule(spark, d, "deeply-nested-routes", {"maxDepth": 1}, routes=a.routes(spark, d))


@query(f"WITH {_RESOLVED} SELECT {told('long-relative-import', 'warning', 'source_path', 'line', 'said')} FROM (SELECT source_path, line, source || ' traverses 1 parent directories.' AS said FROM r WHERE type = 'relative')")
def long_relative_imports(spark: SparkSession, d: str) -> DataFrame:
    return run_rule(spark, d, "long-relative-import", {"maxParentTraversals": 0}, imports=a.imports(spark, d))


@query(f"WITH {_RESOLVED}, e AS (SELECT DISTINCT file_id, coalesce(target_id, source) AS t FROM r), x AS (SELECT m.path, 4 + len(string_split(text, chr(10))) / 25 + (SELECT count(*) FROM e WHERE e.file_id = m.id) + (SELECT count(*) FROM e WHERE e.t = m.id) AS v FROM m JOIN documents USING (doc_id)) SELECT {told('god-module', 'warning', 'path', '1', 'said')} FROM (SELECT path, path || ' has combined complexity score ' || CASE WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE v::VARCHAR END || '.' AS said FROM x WHERE v > 8)")
def god_modules(spark: SparkSession, d: str) -> DataFrame:
    done = resolve.classify(_resolved(spark, d))
    modules = a.modules(spark, d)
    edges = graph.upsert_edges(resolve.statements_of(done).withColumn("target", F.coalesce("target", F.lit(""))))
    return run_rule(spark, d, "god-module", {"maxScore": 8}, modules=modules, degrees=graph.degrees(modules, edges))


@query(f"WITH {_RESOLVED} SELECT {told('orphan-module', 'warning', 'path', '1', 'said')} FROM (SELECT path, path || ' has no incoming or outgoing dependencies.' AS said FROM m WHERE id NOT IN (SELECT file_id FROM r WHERE target_id IS NOT NULL) AND id NOT IN (SELECT target_id FROM r WHERE target_id IS NOT NULL))")
def orphan_modules(spark: SparkSession, d: str) -> DataFrame:
    modules = a.modules(spark, d)
    edges = _resolved(spark, d).where("target_id IS NOT NULL").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    return run_rule(spark, d, "orphan-module", modules=modules, orphans=graph.orphans(resolve.module_nodes(modules), edges))


# --- scalar functions and the scan --------------------------------------------------------------------------------------------


@query("SELECT doc_id, len(string_split(text, chr(10)))::INTEGER AS physical, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(trim(x), '^(//|/\\*|\\*)')))::INTEGER AS logical FROM documents")
def line_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", physical_lines(F.col("text")).alias("physical"), logical_lines(F.col("text")).alias("logical"))


@query(f"WITH {_RESOLVED} SELECT file_id, line, (len(string_split(source, '../')) - 1)::INTEGER AS up, sha256(file_id || ':' || source) AS id FROM r")
def import_measures(spark: SparkSession, d: str) -> DataFrame:
    return a.imports(spark, d).select("file_id", "line", parent_steps(F.col("source")).alias("up"), key(F.col("file_id"), F.col("source")).alias("id"))


@query("SELECT page_id::VARCHAR AS file_id, len(list_filter(string_split(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '/'), lambda x: x <> ''))::INTEGER AS depth FROM pages")
def route_depths(spark: SparkSession, d: str) -> DataFrame:
    return a.routes(spark, d).select("file_id", route_depth(F.col("path")).alias("depth"))


@query(f"WITH {_MODULES} SELECT m.id AS doc_id, sha256(path) AS id, path, '.ts' AS extension, n_chars > 5000 AS is_skipped FROM m JOIN documents USING (doc_id) WHERE NOT regexp_matches(path, '^(.*/)?src3/.*$') AND NOT regexp_matches(path, '^(.*/)?m1[^/]*5\\.ts$')")
def project_scan(spark: SparkSession, d: str) -> DataFrame:
    listing = a.files(spark, d).select("path", "size", F.lit(0).alias("last_modified"))
    done = project.scan(listing, ("src3/**", "m1*5.ts"), most_bytes=5000)
    return done.select(F.regexp_extract("path", r"m(\d+)\.ts$", 1).alias("doc_id"), "id", "path", "extension", "is_skipped")


@query(f"WITH {_MODULES} SELECT count(*) AS total_files, 0::BIGINT AS hidden_files, 0::BIGINT AS workspace_packages, count(*) AS source_files, count(*) FILTER (n_chars > 5000) AS skipped_files, arg_min(path, (-n_chars, path)) AS largest_file FROM m JOIN documents USING (doc_id)")
def scan_counters(spark: SparkSession, d: str) -> DataFrame:
    listing = a.files(spark, d).select("path", "size", F.lit(0).alias("last_modified"))
    return project.counters(listing, project.scan(listing, most_bytes=5000))


@query("SELECT doc_id, regexp_matches(source || '/' || lang, '(^|.*/)src1[^/]*/e.*$') AS hit, CASE lang WHEN 'en' THEN 'next' WHEN 'fr' THEN 'react' WHEN 'de' THEN 'vue' ELSE 'unknown' END AS framework FROM documents")
def globs_and_frameworks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    needs = F.when(F.col("lang") == "en", F.array(F.lit("react"), F.lit("next"))).when(F.col("lang") == "fr", F.array(F.lit("react"))).when(F.col("lang") == "de", F.array(F.lit("vue"))).otherwise(F.array(F.lit("left-pad")))
    return docs.select("doc_id", F.concat("source", F.lit("/"), "lang").rlike(ignore_glob("/src1*/e**")).alias("hit"), project.framework(needs).alias("framework"))
