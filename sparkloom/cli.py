"""python -m sparkloom.cli analyze PATH [--json FILE] [--html FILE] [--policies FILE] [--history TABLE] [--archive FOLDER] [--tables FOLDER] [--compact] [--follow-links] | doctor | init PATH | version

SPARKLOOM_DEBUG=true in the environment tells of every stage on the error output.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import uuid
from collections.abc import Mapping
from pathlib import Path
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import SparkSession

VERSION = "0.1.0"
_LOG = logging.getLogger("sparkloom")


def log_level(environment: Mapping[str, str]) -> int:
    """DEBUG if the environment asks for it, else WARNING."""
    return logging.DEBUG if environment.get("SPARKLOOM_DEBUG", "").lower() == "true" else logging.WARNING


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: it failed; 2: the call was wrong (argparse)."""
    parser = argparse.ArgumentParser(prog="sparkloom")
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("analyze", aliases=["analyse"])
    run.add_argument("path")
    for name in ("json", "html", "benchmark", "history", "policies", "archive", "tables"):
        run.add_argument(f"--{name}")
    for name in ("compact", "follow-links"):
        run.add_argument(f"--{name}", action="store_true")
    sub.add_parser("doctor")
    sub.add_parser("init").add_argument("path")
    sub.add_parser("version")
    said = parser.parse_args(argv)
    if not _LOG.handlers:
        _LOG.addHandler(logging.StreamHandler())
        _LOG.handlers[0].setFormatter(logging.Formatter("[%(levelname)s] %(message)s"))
    _LOG.setLevel(log_level(os.environ))
    try:
        if said.command == "version":
            print(VERSION)
        elif said.command == "doctor":
            import pyspark

            print(f"sparkloom {VERSION}, pyspark {pyspark.__version__}, python {sys.version.split()[0]}")
        elif said.command == "init":
            from .sources.artifacts import save

            print(save(json.dumps({"extends": ["recommended"], "policies": []}, indent=2) + "\n", Path(said.path) / ".loom.json"))
        else:
            _analyze(said)
    except Exception as e:  # noqa: BLE001  the shell gets a code, a person the reason
        _LOG.debug("failed", exc_info=True)
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


def _analyze(said: argparse.Namespace) -> None:
    from pyspark.sql import SparkSession

    from .plans.engine import analyze
    from .sources import artifacts

    spark = SparkSession.builder.appName("sparkloom").getOrCreate()
    profile = artifacts.benchmark_profile(json.loads(Path(said.benchmark).read_text())) if said.benchmark else None
    past = artifacts.history(spark, said.history) if said.history else None
    found = analyze(spark, said.path, said.policies, follow_links=said.follow_links, progress=lambda stage: _LOG.debug("stage %s", stage))
    for rule, why in found.failed_rules.items():
        _LOG.warning("rule %s failed: %s", rule, why)
    report = said.json or said.html
    whole = found.write(_tables_folder(spark, said.tables, report)) if report else None
    done = found.artifact(history=past, benchmark=profile, whole=whole)
    if said.history:
        artifacts.archive(spark, said.history, done["metadata"]["generated_at"], done["summary"]["overall"])
    if said.archive:
        artifacts.archive_report(artifacts.as_json(done), said.archive, done["metadata"]["generated_at"])
    for path, text in ((said.json, artifacts.as_json), (said.html, artifacts.as_html)):
        if path:
            artifacts.save(text(done), path)
    print(artifacts.as_text(done, said.compact))


def _tables_folder(spark: SparkSession, given: str | None, report: str) -> str:
    """Where the whole tables go: where the call says, beside the report where the executors share its disk, else to the shared folder."""
    from .functions.session import shared_dir

    name = f"{Path(report).stem}-{uuid.uuid4().hex[:8]}"
    if given:
        return f"{given.rstrip('/')}/{name}"
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return f"{Path(report).resolve().parent.as_uri()}/{name}"
    return f"{shared_dir(spark)}/sparkloom/{name}"


if __name__ == "__main__":
    sys.exit(main())
