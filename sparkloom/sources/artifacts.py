"""Artifacts: the analysis as JSON, its checks, a page, console text, the history table, and a benchmark profile's reader.

What is gathered here is the report's bounded part: scores, the first findings and hotspots, counts. Whole tables stay tables.
"""

from __future__ import annotations

import html
import json
import math
import re
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import VariantVal

from ..functions import metadata

SECTIONS = ("metadata", "project", "summary", "metrics", "score", "findings", "graph", "analysis")
SCHEMA_ID, VERSION = "sparkloom:analysis:1", "1.0.0"
SENSITIVE = re.compile(metadata.SENSITIVE)
SCHEMA = {
    "$id": SCHEMA_ID, "$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "additionalProperties": False,
    "properties": {s: {"type": "array", "items": {"type": "object"}} if s == "findings" else {"type": "object"} for s in SECTIONS}, "required": [*SECTIONS],
}


def benchmark_profile(told: object) -> dict:
    """A checked profile: cohort, sampleSize, score with ascending p25, p50 and p75, version, framework if said."""
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)
    text = lambda x: isinstance(x, str) and x.strip() != ""
    score = told.get("score") if isinstance(told, dict) else None
    marks = [score.get(k) for k in ("p25", "p50", "p75")] if isinstance(score, dict) else []
    if not marks:
        raise TypeError("a profile has a score distribution")
    if not all(map(number, marks)) or not 0 <= marks[0] <= marks[1] <= marks[2] <= 100:
        raise TypeError("percentiles ascend from 0 to 100")
    if not text(told.get("cohort")) or not text(told.get("version")) or ("framework" in told and not text(told["framework"])):
        raise TypeError("cohort, version and framework are texts")
    if not isinstance(told.get("sampleSize"), int) or isinstance(told["sampleSize"], bool) or told["sampleSize"] < 1:
        raise TypeError("sampleSize is a positive integer")
    return {"cohort": told["cohort"].strip(), "sampleSize": told["sampleSize"], "score": dict(zip(("p25", "p50", "p75"), marks, strict=True)), "version": told["version"].strip()} | ({"framework": told["framework"].strip()} if "framework" in told else {})


def sanitized(value: object) -> object:
    """Sensitive keys dropped at every depth, keys sorted, numbers that aren't finite as null."""
    if isinstance(value, dict):
        return {k: sanitized(value[k]) for k in sorted(value) if not SENSITIVE.search(k)}
    if isinstance(value, list):
        return [sanitized(x) for x in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def _absolute(path: object) -> bool:
    return bool(re.match(r"[/\\\\]|[A-Za-z]:[/\\\\]", str(path)))


def _unsafe(value: object) -> bool:
    if isinstance(value, str):
        return _absolute(value)
    if isinstance(value, list):
        return any(map(_unsafe, value))
    if isinstance(value, dict):
        return any(SENSITIVE.search(k) or _unsafe(v) for k, v in value.items())
    return isinstance(value, float) and not math.isfinite(value)


def checked(artifact: dict) -> dict:
    """The artifact, if it is safe to publish: its sections in order, a relative root, no absolute path or sensitive key."""
    if not isinstance(artifact, dict) or tuple(artifact) != SECTIONS:
        raise TypeError("an artifact has its eight sections in order")
    if not isinstance(artifact["metadata"], dict) or artifact["metadata"].get("schema") != SCHEMA_ID or artifact["metadata"].get("version") != VERSION:
        raise TypeError("the metadata names the schema and its version")
    if not isinstance(artifact["findings"], list) or not isinstance(artifact["project"], dict) or artifact["project"].get("root") != ".":
        raise TypeError("an artifact has findings and a relative root")
    nodes = artifact["graph"].get("nodes", []) if isinstance(artifact["graph"], dict) else []
    places = [f.get("file", "") for f in artifact["findings"]] + [n.get("path", "") for n in nodes]
    if any(map(_absolute, places)) or any(_unsafe(x.get("metadata")) for x in [*artifact["findings"], *nodes]):
        raise TypeError("no absolute paths, endless numbers or sensitive keys")
    return artifact


def rows(df: DataFrame, most: int) -> list[dict]:
    """The first rows, as plain values."""
    plain = lambda v: json.loads(v.toJson()) if isinstance(v, VariantVal) else v
    return [{k: plain(v) for k, v in r.asDict(recursive=True).items()} for r in df.limit(most).collect()]


def as_json(artifact: dict) -> str:
    return json.dumps(checked(artifact), indent=2, ensure_ascii=False) + "\n"


def as_html(artifact: dict) -> str:
    """A page by itself; the data can't end its script."""
    data = json.dumps(checked(artifact), ensure_ascii=False)
    for c, e in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        data = data.replace(c, e)
    s = artifact["summary"]
    cells = "".join(f"<tr><td>{html.escape(str(f['severity']))}</td><td>{html.escape(str(f['title']))}</td><td>{html.escape(str(f['file']))}:{f['line']}</td></tr>" for f in artifact["findings"])
    return f'<!doctype html><meta charset="utf-8"><title>Analysis</title><h1>{s["overall"]} ({html.escape(s["grade"])})</h1><table>{cells}</table><script type="application/json" id="analysis">{data}</script>\n'


def text_table(head: list[str], body: list[list[object]]) -> str:
    width = [max(len(str(r[i])) for r in [head, *body]) for i in range(len(head))]
    line = lambda r: "  ".join(str(x).ljust(w) for x, w in zip(r, width, strict=True)).rstrip()
    return "\n".join([line(head), line(["-" * w for w in width]), *map(line, body)])


def as_text(artifact: dict, compact: bool = False) -> str:
    s = artifact["summary"]
    top = f"Score {s['overall']} ({s['grade']}): {s['critical']} critical, {s['error']} errors, {s['warning']} warnings, {s['info']} infos"
    first = [f for f in artifact["findings"] if f["severity"] != "info"][:3]
    return top if compact else "\n".join([top, "", text_table(["severity", "rule", "place", "what"], [[f["severity"], f["rule_id"], f"{f['file']}:{f['line']}", f["description"]] for f in first])])


def archive(spark: SparkSession, path: str, generated_at: str, overall: float) -> None:
    """Adds a point to the history table."""
    spark.createDataFrame([(generated_at, float(overall))], "generated_at string, overall double").coalesce(1).write.mode("append").parquet(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    """generated_at, overall: from a history table, or else from a folder of JSON artifacts of any version, of which those that can't be read are left out."""
    try:
        points = archived(spark, path)
        if not points.isEmpty():
            return points.select("generated_at", "overall")
        return spark.read.schema("generated_at string, overall double").parquet(path).where("generated_at IS NOT NULL AND overall IS NOT NULL")
    except AnalysisException:  # no such folder yet
        return spark.createDataFrame([], "generated_at string, overall double")


#: Versions of artifacts, the latest first: where they say when they were made and what the score was. Each is read as it is.
VERSIONS = (("1.0.0", "$.metadata.generated_at", "$.summary.overall"), ("legacy", "$.metadata.generatedAt", "$.summary.overallScore"))


def points_of(artifact: Column) -> Column:
    """struct<version, generated_at, overall> of an artifact (a variant): of the first version that it has the shape of, else null."""
    out = F.lit(None).cast("struct<version: string, generated_at: string, overall: double>")
    for name, when, score in reversed(VERSIONS):
        at, n = F.try_variant_get(artifact, when, "variant"), F.try_variant_get(artifact, score, "variant")
        fits = (F.schema_of_variant(at) == "STRING") & F.schema_of_variant(n).rlike("^(BIGINT|DOUBLE|DECIMAL)")
        out = F.when(fits, F.struct(F.lit(name).alias("version"), at.try_cast("string").alias("generated_at"), n.try_cast("double").alias("overall"))).otherwise(out)
    return out


def archived(spark: SparkSession, path: str, most: int = 7) -> DataFrame:
    """version, generated_at, overall, report (where its page is): the latest points of a folder of artifacts, and of its `history`, read by Spark whatever their version.

    What isn't JSON, or no artifact, is left out.
    """
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_name").alias("name"))
    points = rows.select("name", points_of(F.try_parse_json("value")).alias("p")).where("p IS NOT NULL").select("p.*", "name")
    page = F.concat(F.lit("history/"), F.regexp_replace(F.regexp_replace("name", "^analysis-", "report-"), r"\.json$", ".html"))
    last = points.withColumn("report", page).orderBy(F.desc("generated_at"), F.desc("name")).limit(most)
    return last.orderBy("generated_at", "name").drop("name")


def migrate_archives(folder: str | Path) -> list[Path]:
    """Moves the artifacts and pages that older versions kept in a folder itself to its `history`, under free names; the places they have now."""
    moved = []
    for p in sorted(Path(folder).glob("*")):
        if re.fullmatch(r"analysis-.*\.json|report-.*\.html", p.name) and p.is_file():
            to, n = Path(folder) / "history" / p.name, 2
            to.parent.mkdir(exist_ok=True)
            free = to
            while free.exists():
                free, n = to.with_stem(f"{to.stem}-{n}"), n + 1
            moved.append(p.rename(free))
    return moved


def archive_report(text: str, folder: str | Path, generated_at: str) -> Path:
    """Keeps a JSON artifact in the `history` of a folder, under a name from its time; what older versions kept in the folder goes there too."""
    migrate_archives(folder)
    return save(text, Path(folder) / "history" / f"analysis-{re.sub('[^0-9A-Za-z]+', '-', generated_at).strip('-')}.json")


def save(text: str, path: str | Path) -> Path:
    """Writes a text; if there is a file of that name, under the next free one."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    free, n = path, 1
    while free.exists():
        free, n = path.with_stem(f"{path.stem}-{n}"), n + 1
    free.write_text(text, encoding="utf-8")
    return free
