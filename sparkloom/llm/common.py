"""What the text operators share: reading, shared intermediate tables, bounded broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.session import bounded, dropped, shipped, stored, table  # noqa: F401  for the operators


def repeats(df: DataFrame, key: str) -> bool:
    """Whether a key occurs twice."""
    return not df.groupBy(key).count().where("count > 1").isEmpty()


def nonnull(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


#: Rows that go to a Python worker at once, unless the session says otherwise than Spark's default: texts can be long.
BATCH_ROWS = 2000


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    spark = df.sparkSession
    shipped(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.mapInArrow(_tidied(run), schema)


def _tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving back at its end the memory that it no longer uses: workers live on for other tasks."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):
            ctypes.CDLL(None).malloc_trim(0)

    return tidy
