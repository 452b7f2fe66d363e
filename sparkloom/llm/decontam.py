"""Benchmark decontamination through a positional inverted index.

Words are runs of digits, lower-cased A-Z and non-ASCII characters. A benchmark text's windows are its runs of WINDOW words; a
shorter text is one window. The steps, all Spark expressions and joins:

1. `term_counts`: how often each benchmark term occurs in all texts (counted before the shuffle).
2. `anchors`: the two rarest terms of every window; a window with a term that never occurs is out.
3. `postings`: the index (term, doc, positions) of the anchor terms, over whole texts.
4. `candidates`: postings meet the item's own positions; the offset-adjusted lists are intersected by (doc, item, offset), and a
   window stays where both its rarest terms stand on one offset.
5. `matches`: the surviving windows are compared word by word with the text.

`phrases_within` gives proximity matches from the same index: texts with all of an item's terms within a span of words.

Null texts have no words. Equal rows are judged each for itself. Items with null ids mark words but have no id to report.
Other columns of the texts pass through, whatever their names; columns of the results' names are replaced. Other columns of the
benchmark are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, nonnull, stored, table

WINDOW = 13
#: Document words times this must reach the hit words for a text to be contaminated.
SHARE = 20
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    t = nonnull(text)
    lowered = F.when(t.rlike(r"[^\x00-\x7F]"), F.translate(t, _UPPER, _LOWER)).otherwise(F.lower(t))
    return F.array_remove(F.split(lowered, _BREAK, -1), "")


def items_of(benchmark: DataFrame) -> DataFrame:
    """The distinct items with words: item_id, item (a key), item_words."""
    b = benchmark.select("item_id", words(F.col("text")).alias("item_words")).distinct()
    return b.where(F.size("item_words") > 0).withColumn("item", F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("item_id").isNull(), "item_words"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: occurrences in all texts of docs, for the given terms."""
    return docs.select(F.explode(words(F.col("text"))).alias("term")).join(bounded(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def anchors(items: DataFrame, counts: DataFrame) -> DataFrame:
    """item, windows: array<struct<start, size, a, b>>: the offsets in the item of each window's two rarest terms."""
    spots = items.select("item", F.size("item_words").alias("size"), F.posexplode("item_words").alias("at", "term")).join(counts, "term")
    ranked = spots.groupBy("item", "size").agg(F.array_sort(F.collect_list(F.struct("n", "at"))).alias("spots"))  # as long as the item
    starts = F.sequence(F.lit(0), F.greatest(F.col("size") - WINDOW, F.lit(0)))
    width = F.least(F.col("size"), F.lit(WINDOW))

    def window(s: Column) -> Column:
        inside = F.filter("spots", lambda x: (x["at"] >= s) & (x["at"] < s + width))
        return F.struct(s.alias("start"), width.alias("size"), F.when(F.size(inside) == width, inside[0]["at"]).alias("a"), F.when(F.size(inside) == width, F.coalesce(F.get(inside, F.lit(1))["at"], inside[0]["at"])).alias("b"))

    return ranked.select("item", F.filter(F.transform(starts, window), lambda w: w["a"].isNotNull()).alias("windows")).where(F.size("windows") > 0)


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc, term, at: where the given terms stand in the texts."""
    return docs.select("doc", F.posexplode(words(F.col("text"))).alias("at", "term")).join(bounded(terms), "term")


def candidates(docs: DataFrame, items: DataFrame, windows: DataFrame) -> DataFrame:
    """doc, item, offset, windows: the windows whose two rarest terms both stand on that offset in the text."""
    spots = windows.select("item", F.explode("windows").alias("w")).select("item", F.explode(F.array("w.a", "w.b")).alias("item_at")).distinct()
    spots = items.select("item", F.posexplode("item_words").alias("item_at", "term")).join(spots, ["item", "item_at"])
    met = postings(docs, spots.select("term").distinct()).join(bounded(spots), "term")
    lists = met.groupBy("doc", "item", (F.col("at") - F.col("item_at")).alias("offset")).agg(F.collect_set("item_at").alias("on"))  # as long as the item
    both = lambda w: F.array_contains("on", w["a"]) & F.array_contains("on", w["b"])
    return lists.join(bounded(windows), "item").select("doc", "item", "offset", F.filter("windows", both).alias("windows")).where(F.size("windows") > 0)


def matches(docs: DataFrame, found: DataFrame, items: DataFrame) -> DataFrame:
    """docs with n_words, hit (the positions inside occurring windows) and items (the ids whose windows occur).

    Texts without candidates pass through; the others get theirs by a left join, broadcast if it is counted to be small.
    """
    by_doc = found.join(bounded(items), "item").groupBy("doc").agg(F.collect_list(F.struct("item_id", "item_words", "offset", "windows")).alias("found"))  # as many as the text has windows
    joined = docs.join(bounded(by_doc), "doc", "left").withColumn("words", words(F.col("text")))

    def holds(x: Column, w: Column) -> Column:
        at = x["offset"] + w["start"]
        return (at >= 0) & (F.slice("words", F.greatest(at, F.lit(0)) + 1, w["size"]) == F.slice(x["item_words"], w["start"] + 1, w["size"]))

    real = F.transform("found", lambda x: F.struct(x["item_id"].alias("item_id"), F.flatten(F.transform(F.filter(x["windows"], lambda w: holds(x, w)), lambda w: F.sequence(x["offset"] + w["start"], x["offset"] + w["start"] + w["size"] - 1))).alias("at")))
    kept = joined.withColumn("n_words", F.size("words").cast("long")).withColumn("real", F.filter(real, lambda x: F.size(x["at"]) > 0)).drop("words", "found")
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("real", lambda x: x["item_id"].cast("string")), lambda i: i.isNotNull())))
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    return kept.withColumn("hit", F.coalesce(F.array_distinct(F.flatten(F.transform("real", lambda x: x["at"]))), empty("int"))).withColumn("items", F.coalesce(ids, empty("string"))).drop("real")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with n_words, n_hit, items (sorted ids as strings) and contaminated."""
    items = stored(items_of(benchmark), "items")
    results = ("n_words", "n_hit", "items", "contaminated")
    kept = [c for c in docs.columns if c not in results]
    marked = docs.select(F.struct(*kept).alias("row"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("doc"), "text")  # whatever the columns' names
    thin = marked.select("doc", "text")
    counts = term_counts(thin, items.select(F.explode("item_words").alias("term")).distinct())
    windows = stored(anchors(items, counts), "anchors")
    found = stored(candidates(thin, items, windows), "candidates")
    out = matches(marked, found, items).withColumn("n_hit", F.size("hit").cast("long"))
    contaminated = (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in kept), "n_words", "n_hit", "items", contaminated.alias("contaminated"))


def phrases_within(docs: DataFrame, benchmark: DataFrame, span: int, key: str = "doc_id") -> DataFrame:
    """Proximity matches: (key, item_id, start) where all of an item's distinct terms stand within `span` words from position start.

    For each text and item, the latest place of every term seen so far is carried along by window functions over the postings.
    """
    items = items_of(benchmark)
    terms = items.select("item", "item_id", F.explode(F.array_distinct("item_words")).alias("term"), F.size(F.array_distinct("item_words")).alias("n_terms"))
    thin = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("doc"), F.col(key), "text")
    met = postings(thin, terms.select("term").distinct()).join(bounded(terms), "term")
    near = Window.partitionBy("doc", "item").orderBy("at").rangeBetween(0, span - 1)
    full = met.withColumn("seen", F.size(F.collect_set("term").over(near))).where(F.col("seen") == F.col("n_terms"))
    return full.join(thin.select("doc", key).distinct(), "doc").select(key, "item_id", F.col("at").alias("start")).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = "regexp_extract_all(translate({0}, '" + _UPPER + "', '" + _LOWER + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS p FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS k, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, s, array_to_string(w[s:s + k - 1], ' ') AS p FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes WHERE len(w) >= k)),
m AS (SELECT r, dw.k, s, item_id FROM dw JOIN bw ON dw.p = bw.p AND dw.k = bw.k),
h AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS pos FROM m) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
