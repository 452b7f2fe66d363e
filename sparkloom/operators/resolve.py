"""Import resolution: relative and alias specifiers to modules, as joins on candidate paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SOURCE_EXTENSIONS, basename, dirname, join_path, key, without_source_extension
from ..functions.metadata import metadata


def with_re_exports(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """The imports, and the exports that name a source as static imports."""
    kind = F.when(F.col("source").startswith("."), F.lit("relative")).otherwise(F.lit("package"))
    more = exports.where(F.col("source").isNotNull()).select("file_id", F.lit(False).alias("is_dynamic"), "is_type_only", "line", "source", F.array("name").alias("specifiers"), kind.alias("type"))
    columns = ["file_id", "is_dynamic", "is_type_only", "line", "source", "specifiers", "type"]
    return imports.select(*columns).unionByName(more.select(*columns))


def resolve(statements: DataFrame, modules: DataFrame) -> DataFrame:
    """statements with source_id, source_path, target_id, target_path (null where nothing is found).

    statements: file_id, source, type and more; modules: id, file_id, path. Statements of unknown files are dropped. A relative
    specifier has 17 candidate paths, and of the modules there the one of the least id wins. `@/x` means `src/x` with any source
    extension, there or below some directory, if exactly one module answers. Equal specifiers of one directory are resolved once.
    """
    from_ = modules.select("file_id", F.col("id").alias("source_id"), F.col("path").alias("source_path"))
    known = statements.join(from_, "file_id").withColumn("_dir", dirname(F.col("source_path")))
    asked = known.where(F.col("source").startswith(".")).select("_dir", "source").distinct()
    base = join_path(F.col("_dir"), F.col("source"))
    paths = F.concat(F.array(base), F.array(*(F.concat(base, F.lit(e)) for e in SOURCE_EXTENSIONS)), F.array(*(F.concat(base, F.lit("/index" + e)) for e in SOURCE_EXTENSIONS)))
    relative = asked.withColumn("path", F.explode(paths)).join(modules.select("id", "path"), "path").groupBy("_dir", "source").agg(F.min(F.struct("id", "path")).alias("t"))
    plain = modules.select("id", "path", without_source_extension(F.col("path")).alias("plain"))
    parts = F.split("plain", "/", -1)
    tails = plain.select("id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("tail")).where(F.col("tail").startswith("src/"))
    alias = known.where(F.col("source").startswith("@/")).select("source").distinct().withColumn("tail", F.concat(F.lit("src/"), F.substr("source", F.lit(3))))
    single = alias.join(tails, "tail").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "path")).alias("t")).where("n = 1").select("source", F.col("t").alias("a"))
    done = known.join(relative, ["_dir", "source"], "left").join(single, "source", "left")
    target = F.coalesce("t", "a")
    return done.select(*statements.columns, "source_id", "source_path", target["id"].alias("target_id"), target["path"].alias("target_path"))


def classify(resolved: DataFrame) -> DataFrame:
    """resolved with target (a node id), target_type (module, missing, package), is_broken and is_external."""
    missing = F.col("target_id").isNull() & (F.col("type") == "relative")
    kind = F.when(F.col("target_id").isNotNull(), F.lit("module")).when(missing, F.lit("missing")).otherwise(F.lit("package"))
    target = F.when(missing, key("missing", F.col("source_path"), F.col("source"))).otherwise(key("package", F.col("source")))
    return resolved.withColumn("target_type", kind).withColumn("target", F.coalesce("target_id", target)).withColumn("is_broken", kind == "missing").withColumn("is_external", kind == "package")


def target_nodes(classified: DataFrame) -> DataFrame:
    """id, label, path, type, metadata: the missing and package nodes."""
    rows = classified.where("target_type <> 'module'").select(F.col("target").alias("id"), F.col("source").alias("label"), F.col("source").alias("path"), F.col("target_type").alias("type")).distinct()
    return rows.withColumn("metadata", F.when(F.col("type") == "missing", metadata(missing=F.lit(True))).otherwise(metadata()))


def module_nodes(modules: DataFrame) -> DataFrame:
    """id, label, path, type, and metadata of what the modules have of it."""
    told = {name: F.col(c) for name, c in (("fileId", "file_id"), ("functionCount", "function_count"), ("lineCount", "line_count")) if c in modules.columns}
    return modules.select("id", basename(F.col("path")).alias("label"), "path", F.lit("module").alias("type"), metadata(**told).alias("metadata"))


def statements_of(classified: DataFrame) -> DataFrame:
    """What upsert_edges takes."""
    return classified.select(F.col("source_id").alias("source"), "target", "is_dynamic", "is_broken", "is_external")
