"""Rules of others as table functions: one class, run by the engine beside the catalogue and by anyone from SQL.

A rule's class says which columns part its input and in which order its rows come (`by`, `order`), and has `eval(row)`, called for each
row, and `end()`, called after a part's last row. Both yield findings (see found). Its thresholds are its fields, with defaults: they are
arguments of the table function, where a name or value that doesn't fit is an error before anything runs.

    class ManyImports(TableRule):
        by, order = ("file_id",), ("line",)
        most: int = 20

        def begin(self):
            self.n = 0

        def eval(self, row):
            self.n, self.last = self.n + 1, row

        def end(self):
            if self.n > self.most:
                yield found("Many imports", f"The file has {self.n} imports.", self.last["file_id"], threshold=self.most)

    register(spark, "many_imports", ManyImports)
    spark.sql("SELECT * FROM many_imports(TABLE(imports), most => 30)")
    as_rule("many-imports", "imports", "warning", ManyImports, "imports")       # for Registry

Parts are dealt by Spark and streamed, so a rule holds what it keeps itself. An input without rows has no findings.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, Row, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..functions.session import shipped
from . import rules

_EVIDENCE = StructType([StructField("metric", StringType()), StructField("value", StringType())])
FINDING = StructType([StructField(n, StringType()) for n in ("title", "description", "rationale", "recommendation", "file_id")] + [StructField("line", IntegerType()), StructField("evidence", ArrayType(_EVIDENCE))])


def found(title: str, description: str, file_id: str | None = None, line: int = 1, rationale: str = "", recommendation: str = "", **evidence: object) -> tuple:
    """A finding, as rules yield it; evidence: what was measured."""
    return title, description, rationale, recommendation, file_id, line, [(k, str(v)) for k, v in evidence.items()]


class TableRule:
    by: tuple[str, ...] = ()
    order: tuple[str, ...] = ()

    def begin(self) -> None:
        """Before a part's first row."""

    def eval(self, row: Row) -> Iterator[tuple] | None:
        raise NotImplementedError

    def end(self) -> Iterator[tuple] | None:
        """After a part's last row."""


def thresholds(rule: type[TableRule]) -> dict[str, type]:
    """The rule's own fields that have a type and a default."""
    return {k: t for k, t in get_type_hints(rule).items() if k not in ("by", "order") and hasattr(rule, k)}


def handler(rule: type[TableRule]) -> type:
    """The class of a table function that runs the rule."""
    known = thresholds(rule)

    class Handler:
        @staticmethod
        def analyze(table: AnalyzeArgument, **given: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError("the first argument is a table: TABLE(name)")
            lacking = [c for c in (*rule.by, *rule.order) if c not in table.dataType.names]
            if lacking:
                raise ValueError(f"the table has no {', '.join(lacking)}")
            for name, v in given.items():
                if name not in known:
                    raise ValueError(f"no threshold {name}; there are {', '.join(known) or 'none'}")
                if v.value is None or isinstance(v.value, bool) or isinstance(v.value, str) != (known[name] is str):
                    raise ValueError(f"{name} is no {known[name].__name__}: {v.value!r}")
            return AnalyzeResult(FINDING, withSinglePartition=not rule.by, partitionBy=[PartitioningColumn(c) for c in rule.by], orderBy=[OrderingColumn(c) for c in rule.order])

        def __init__(self) -> None:
            self.rule: TableRule | None = None

        def eval(self, table: Row, **given: object) -> Iterator[tuple]:
            if self.rule is None:
                self.rule = rule()
                for name, v in given.items():
                    setattr(self.rule, name, known[name](v))
                self.rule.begin()
            yield from self.rule.eval(table) or ()

        def terminate(self) -> Iterator[tuple]:
            if self.rule is not None:
                yield from self.rule.end() or ()

    Handler.__name__ = rule.__name__
    return Handler


def register(spark: SparkSession, name: str, rule: type[TableRule]) -> None:
    """Makes the rule a table function of that name: name(TABLE(input), threshold => value ...)."""
    shipped(spark)
    spark.udtf.register(name, F.udtf(handler(rule)))


def as_rule(id: str, category: str, severity: str, rule: type[TableRule], table: str) -> rules.Rule:
    """The rule for a Registry, over a table of the context; its thresholds are those that the context says for its id."""

    def run(ctx: rules.Context) -> DataFrame:
        rows = ctx[table]
        spark, name, view = rows.sparkSession, f"rule_{uuid.uuid4().hex}", f"input_{uuid.uuid4().hex}"
        register(spark, name, rule)
        rows.createOrReplaceTempView(view)
        said = {k: ctx.threshold(id, k, getattr(rule, k)) if t is not str else getattr(rule, k) for k, t in thresholds(rule).items()}
        values = "".join(f", {k} => {v!r}" for k, v in said.items())
        told = spark.sql(f"SELECT * FROM {name}(TABLE({view}){values})")
        return rules.found(told, ctx, F.col("title"), F.col("description"), F.col("rationale"), F.col("recommendation"), F.col("evidence"), F.col("file_id"), F.col("line"))

    return rules.Rule(id, category, severity, run, lambda ctx: table in ctx.tables)
