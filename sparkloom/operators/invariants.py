"""What every report must keep: ids that are unique within their family, and paths that are normal.

All families are checked by one shuffle: (family, id) pairs are counted together, combined before they move, however many tables they
come from.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normalized

#: The tables of a report whose rows have ids.
FAMILIES = ("files", "components", "contexts", "hooks", "modules", "routes", "nodes", "cycles", "findings")
DUPLICATE, PATH = "duplicate id", "path not normal"


class InvalidReport(ValueError):
    """A report breaks an invariant."""


def normal(path: Column) -> Column:
    """Whether a path isn't empty, and has slashes for backslashes and one for several."""
    return F.coalesce((path != "") & (path == normalized(path)), F.lit(False))


def problems(tables: Mapping[str, DataFrame], root: str | None = None) -> DataFrame:
    """code, family, id, times: ids (null ones too) that occur `times` in a family, and files whose path isn't normal; root: of the project, a path too.

    tables: those of FAMILIES that are there. A file is named by its path, the project's root by itself.
    """
    there = [(name, tables[name]) for name in FAMILIES if name in tables]
    spark = there[0][1].sparkSession
    pairs = reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("family"), F.col("id").cast("string").alias("id")) for name, df in there))
    twice = pairs.groupBy("family", "id").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    out = twice.select(F.lit(DUPLICATE).alias("code"), "family", "id", "times")
    paths = [tables["files"].select(F.lit("files").alias("family"), F.col("path").alias("id"))] if "files" in tables else []
    paths += [spark.createDataFrame([("root", root)], "family string, id string")] if root is not None else []
    for df in paths:
        out = out.unionByName(df.where(~normal(F.col("id"))).groupBy("family", "id").agg(F.count(F.lit(1)).alias("times")).select(F.lit(PATH).alias("code"), "family", "id", "times"))
    return out


def checked(tables: Mapping[str, DataFrame], root: str | None = None, told: int = 5) -> None:
    """Raises InvalidReport, naming the first problems, if there is any."""
    first = problems(tables, root).orderBy("code", "family", "id").limit(told).collect()
    if first:
        raise InvalidReport("; ".join(f"{r['family']}: {r['code']} {r['id']!r}" for r in first))
