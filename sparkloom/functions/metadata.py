"""Metadata of any shape as variants: made from columns, cleaned by expressions before it is published."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of names whose values are never published.
SENSITIVE = r"(?i)api[-_]?key|authorization|cookie|password|secret|source|token|username"
#: Levels of objects and arrays that are published; the expression doubles with each. What is nested deeper is null.
LEVELS = 6


def metadata(**values: Column) -> Column:
    """An object of these names; nulls are left out."""
    if not values:
        return F.parse_json(F.lit("{}"))
    return F.parse_json(F.to_json(F.struct(*(v.alias(k) for k, v in values.items()))))


def _scalar(v: Column) -> Column:
    endless = F.schema_of_variant(v).isin("DOUBLE", "FLOAT") & F.coalesce(v.try_cast("double").isin(float("nan"), float("inf"), float("-inf")), F.lit(False))
    return F.when(endless, F.parse_json(F.lit("null"))).otherwise(v)


def cleaned(v: Column, levels: int = LEVELS) -> Column:
    """The variant without the names that SENSITIVE finds, at every depth; numbers that aren't finite as null. A null variant stays null."""
    named, listed = v.try_cast("map<string,variant>"), v.try_cast("array<variant>")
    if not levels:
        return F.when(named.isNotNull() | listed.isNotNull(), F.parse_json(F.lit("null"))).otherwise(_scalar(v))
    inner = F.transform_values(F.map_filter(named, lambda k, _: ~k.rlike(SENSITIVE)), lambda _, x: cleaned(x, levels - 1))
    items = F.transform(listed, lambda x: cleaned(x, levels - 1))
    return F.when(named.isNotNull(), F.to_variant_object(inner)).when(listed.isNotNull(), F.to_variant_object(items)).otherwise(_scalar(v))
