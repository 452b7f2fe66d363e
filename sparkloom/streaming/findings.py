"""An extension, without a counterpart to match: findings that arrive as a stream, scored by window.

The stream's rows have ts and the findings' rule_id, category and severity. Counts by window, rule, category and severity are all that
a window keeps, as the score follows from them; findings later than the watermark are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import score as scoring


def windowed_counts(stream: DataFrame, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """start, rule_id, category, severity, n: append mode gives a window once it is past the watermark."""
    w = F.window("ts", length)
    return stream.withWatermark("ts", late).groupBy(w, "rule_id", "category", "severity").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "rule_id", "category", "severity", "n")


def windowed_adjustments(counts: DataFrame) -> DataFrame:
    """start, findings, burden, critical_risk: of the closed windows' counts (in foreachBatch, or on a table of them)."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0))
    sums = counts.groupBy("start").agg(F.sum("n").alias("findings"), *(n(s).alias(s) for s in scoring.SEVERITIES))
    return sums.select("start", "findings", scoring.maintenance_burden(F.col("warning"), F.col("info"), F.col("error")).alias("burden"), scoring.critical_adjustment(F.col("critical")).alias("critical_risk"))
