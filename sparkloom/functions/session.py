"""Session and table helpers shared by the operators."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Most rows and bytes of a side that may be broadcast; counted before the hint is given, a larger side is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark alone, so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one only where the session names none and runs in one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("sparkloom.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("sparkloom.shared.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a table in the shared folder and read back: it cuts the lineage, and an executor's loss costs no rerun."""
    path = f"{shared_dir(df.sparkSession)}/sparkloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Gives this package to the session's executors, once, so that Python workers can import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    if top.is_dir():
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/sparkloom/code-{uuid.uuid4().hex}/sparkloom.zip")
        out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(held.getvalue()))
        out.close()
        context.addPyFile(path.toString())
    _SHIPPED.add(context.applicationId)


_NESTED = (StringType, BinaryType, ArrayType, StructType, MapType)


def _bytes(name: str, kind: DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, ArrayType) and not isinstance(kind.elementType, _NESTED):
        return F.greatest(F.size(c), F.lit(0)) * 8 + 16
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and not any(isinstance(f.dataType, _NESTED) for f in kind.elementType):
        return F.greatest(F.size(c), F.lit(0)) * 8 * (len(kind.elementType) + 2) + 16
    return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16 if isinstance(kind, _NESTED) else F.lit(8)


def bounded(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows and BROADCAST_BYTES bytes, both counted; otherwise as it is, to be shuffled."""
    row = F.lit(16)
    for f in df.schema:
        row = row + _bytes(f.name, f.dataType)
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def dropped(df: DataFrame) -> None:
    """Deletes what stored() wrote."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
