"""The corpus pipeline: documents in, token ids out. Each stage works on all that the one before it kept.

toxicity         drops the documents that the classifier chain rejects
line dedup       drops lines that are near copies of earlier ones, and documents of which nothing is left
jaccard join     keeps one document, that of the least doc_id (and of its several texts one), of each group of near copies
decontamination  drops the documents that benchmark windows contaminate
bpe              encodes the texts; returns token ids and a digest of the decoded text

Nulls: a null text is never toxic, near another or contaminated, and has no tokens. Empty tables give empty tables of the same columns.
Rows of equal doc_id and text are one document from the jaccard join on; rows of equal doc_id and other texts are judged each by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, decontam, lines, near, toxicity
from sparkloom.llm.common import bounded, stored, table


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = toxicity.fit(docs.select("doc_id", "text"), toxicity.judgements(table(spark, sf_dir, "labels")))
    kept = docs.select(*(F.col(c).alias(f"_kept_{c}") for c in docs.columns if c != "text"), "text")  # whatever their names
    civil = toxicity.score(kept, chain).where(~F.col("toxic"))
    return civil.select(*(F.col(c if c == "text" else f"_kept_{c}").alias(c) for c in docs.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(docs).select(*docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = near.jaccard_classes(docs.select("doc_id", "text"), links=False)
    gone = stored(classes.where("NOT first").select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct(), "gone")
    same = docs["doc_id"].eqNullSafe(F.col("_gone_id")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("_gone_hash"))
    left = docs.join(bounded(gone), same, "left_anti")
    # rows of equal id and text are one document
    again = stored(docs.groupBy(F.col("doc_id").alias("_again_id"), F.xxhash64("text").alias("_again_hash")).count().where("count > 1").drop("count"), "again")
    if again.isEmpty():
        return left.select(*docs.columns)
    twice = left["doc_id"].eqNullSafe(F.col("_again_id")) & F.xxhash64(left["text"]).eqNullSafe(F.col("_again_hash"))
    rest = bounded(again)
    return left.join(rest, twice, "left_anti").unionByName(left.join(rest, twice, "left_semi").dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return marked.where(~F.col("contaminated")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # executors come to this stage with full heaps: its workers stay small
    done = bpe.encode_texts(docs.select("doc_id", "lang", "source", "text"), remember=40_000)
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", keep_civil),
    ("line dedup", dedup_lines),
    ("jaccard join", keep_distinct),
    ("decontamination", keep_clean),
    ("bpe", encode),
]

#: SQL can't express the classifier, MinHash candidates or BPE; tests/llm/test_pipeline.py holds it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
