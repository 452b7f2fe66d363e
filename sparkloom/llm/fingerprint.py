"""Document fingerprints: a Merkle tree over paragraphs and sections.

A text is split at blank lines into sections and at line ends into paragraphs, and a paragraph into phrases: runs of at most four
words between punctuation marks, with the marks and blanks behind them. A phrase's node, the leaf, is the SHA-256 of its text; a
paragraph's node that of its leaves, a section's node that of its paragraphs' nodes, the root that of the sections' nodes. Equal roots
mean equal texts; where roots differ, `differences` walks down only the branches that differ. `likeness` is the share of the nodes,
leaves and those above them, that two trees have in common: as roots count too, it is 1 for equal texts alone.

Null text counts as empty. The empty text has one section with one empty paragraph and no leaf. Rows with equal ids are each
fingerprinted; other columns are kept, and a column of the same name as a result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import nonnull, table

#: Every character of a paragraph is in one phrase.
PHRASE = r"[^ .,;!?]+(?: [^ .,;!?]+){0,3}[ .,;!?]*|[ .,;!?]+"
#: Rows that neighbours() sorts together, on average; the most ranges that it makes; and ids that it looks at for each range.
BUCKET_ROWS, RANGES, LOOKS = 1024, 1 << 16, 20


def leaves(text: Column) -> Column:
    """The leaves, by section and paragraph: array<array<array<string>>>."""
    of = lambda p: F.transform(F.regexp_extract_all(p, F.lit(PHRASE), F.lit(0)), lambda w: F.sha2(w, 256))
    return F.transform(F.split(nonnull(text), "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), of))


def above(nodes: Column) -> Column:
    """The node over some nodes."""
    return F.sha2(F.array_join(nodes, ""), 256)


def likeness(a: Column, b: Column) -> Column:
    """From the distinct nodes of two trees: their Dice coefficient. Each tree has a root, so none is empty."""
    return F.size(F.array_intersect(a, b)) * 2.0 / F.greatest(F.size(a) + F.size(b), F.lit(1))


def fingerprint(df: DataFrame, text: str = "text", name: str = "") -> DataFrame:
    """df with its tree: root, section_nodes, paragraph_nodes (by section) and nodes (all distinct ones, leaves too); name: of the new columns before _root etc."""
    n = f"{name}_" if name else ""
    tree = df.withColumn(f"{n}leaves", leaves(F.col(text))).withColumn(f"{n}paragraph_nodes", F.transform(f"{n}leaves", lambda s: F.transform(s, above)))
    tree = tree.withColumn(f"{n}section_nodes", F.transform(f"{n}paragraph_nodes", above)).withColumn(f"{n}root", above(F.col(f"{n}section_nodes")))
    every = F.concat(F.flatten(F.flatten(f"{n}leaves")), F.flatten(f"{n}paragraph_nodes"), F.col(f"{n}section_nodes"), F.array(f"{n}root"))
    return tree.withColumn(f"{n}nodes", F.array_distinct(every)).drop(f"{n}leaves")


def differences(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Where the texts of two fingerprinted tables differ: key, section, paragraph (counted from 0), old_node, new_node.

    Only sections whose nodes differ are opened. A key in one table alone gives all its paragraphs, with null for the other's nodes.
    Rows that share a key are compared with each other.
    """
    pick = lambda df, to: df.select(key, F.col("root").alias(f"{to}_root"), F.col("section_nodes").alias(f"{to}_s"), F.col("paragraph_nodes").alias(f"{to}_p"))
    both = pick(old, "old").join(pick(new, "new"), key, "full").where(~F.col("old_root").eqNullSafe(F.col("new_root")))
    empty = F.array().cast("array<string>")
    zipped = both.select(key, F.posexplode(F.arrays_zip(*(F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in (("old_s", "array<string>"), ("new_s", "array<string>"), ("old_p", "array<array<string>>"), ("new_p", "array<array<string>>"))))).alias("section", "s"))
    opened = zipped.where(~F.col("s.old_s").eqNullSafe(F.col("s.new_s"))).select(
        key, "section", F.posexplode(F.arrays_zip(F.coalesce("s.old_p", empty).alias("o"), F.coalesce("s.new_p", empty).alias("n"))).alias("paragraph", "p")
    )
    return opened.where(~F.col("p.o").eqNullSafe(F.col("p.n"))).select(key, "section", "paragraph", F.col("p.o").alias("old_node"), F.col("p.n").alias("new_node"))


def neighbours(df: DataFrame, key: str, value: str, to: str) -> DataFrame:
    """df with `to`: the `value` of the row that follows by ascending `key`; the last row gets the first row's.

    Nulls come first; rows of equal key follow by the hash of `value`. The rows are moved once, to ranges of keys of about equal numbers
    of rows, whose bounds are those of a sample (LOOKS keys a range); a key that is several bounds has as many ranges, by the hash. The
    first row of a range goes on to the range before it. The bounds decide where rows go, not what comes out.
    """
    n = df.count()
    ranges = min(RANGES, n // BUCKET_ROWS)
    kind = dict(df.dtypes)[key]
    looked = df.select(key).where(F.col(key).isNotNull()).sample(min(1.0, ranges * LOOKS / max(1, n)), 3) if ranges else None
    seen = sorted(r[0] for r in looked.collect()) if looked else []  # RANGES times LOOKS bounds them
    bounds = [seen[i * len(seen) // ranges] for i in range(1, ranges)] if seen else []
    told = df.sparkSession.createDataFrame([(bounds,)], f"_bounds array<{kind}>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, len(bounds)).bit_length()))))

    def before(less) -> Column:
        """How many bounds come before the key, by bisection."""
        at = lambda got: F.get("_bounds", got - 1)
        return F.aggregate(steps, F.lit(0), lambda got, k: F.when((got + k <= F.size("_bounds")) & less(at(got + k)), got + k).otherwise(got))

    tie = F.xxhash64(value)
    own = before(lambda b: b < F.col(key))
    if len({*bounds}) < len(bounds):
        times = before(lambda b: b <= F.col(key)) - own
        own = own + F.when(times > 1, F.least(F.floor((tie / F.lit(2.0**64) + 0.5) * times).cast("int"), times - 1)).otherwise(0)
    dealt = df.crossJoin(F.broadcast(told)).withColumn("_b", own).drop("_bounds")  # one row
    order = Window.partitionBy("_b").orderBy(F.col(key).asc_nulls_first(), "_tie")
    rows = dealt.withColumn("_tie", tie).withColumn("_n", F.row_number().over(order)).withColumn("_next", F.lead(F.struct(value)).over(order))
    filled, every = dealt.select("_b").distinct(), Window.orderBy("_b")  # RANGES bounds it
    last = F.max("_b").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    previous = filled.select("_b", F.coalesce(F.lag("_b").over(every), last).alias("_to"))
    firsts = rows.where("_n = 1").select("_b", F.struct(value).alias("_first")).join(previous, "_b").select("_to", "_first")
    joined = rows.join(firsts, (rows["_b"] == firsts["_to"]) & rows["_next"].isNull(), "left")
    return joined.withColumn(to, F.coalesce("_next", "_first")[value]).drop("_b", "_tie", "_n", "_next", "_to", "_first")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", nonnull(F.col("text")).alias("text"))
    pairs = neighbours(docs, "doc_id", "text", "next").withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    pairs = pairs.withColumn("edited", F.concat(F.substring("text", 1, F.col("n_chars").cast("int") - half), F.substring("next", 1, half)))
    for a in ("text", "edited", "next"):
        pairs = fingerprint(pairs, a, a)
    like = lambda other: likeness(F.col("text_nodes"), F.col(f"{other}_nodes"))
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("text_root").alias("fingerprint"), F.col("edited_root").alias("edited_fingerprint"),
        like("edited").alias("near_edited"), like("next").alias("near_next"),
    )


_LEAVES = "list_transform(string_split({0}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '" + PHRASE.replace("{", "{{").replace("}", "}}") + "'), lambda w: sha256(w))))"
_NODES = "list_distinct(list_concat(flatten(flatten({0}_l)), flatten({0}_p), {0}_s, [{0}_root]))"
_LIKE = "len(list_intersect({0}_n, {1}_n)) * 2.0::DOUBLE / (len({0}_n) + len({1}_n))"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n_chars, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS x FROM d),
e AS (SELECT *, substring(t, 1, n_chars - n_chars // 2) || substring(x, 1, n_chars // 2) AS e FROM n),
l AS (SELECT *, {", ".join(f"{_LEAVES.format(c)} AS {c}_l" for c in "tex")} FROM e),
p AS (SELECT *, {", ".join(f"list_transform({c}_l, lambda s: list_transform(s, lambda p: sha256(array_to_string(p, '')))) AS {c}_p" for c in "tex")} FROM l),
s AS (SELECT *, {", ".join(f"list_transform({c}_p, lambda s: sha256(array_to_string(s, ''))) AS {c}_s" for c in "tex")} FROM p),
r AS (SELECT *, {", ".join(f"sha256(array_to_string({c}_s, '')) AS {c}_root" for c in "tex")} FROM s),
f AS (SELECT *, {", ".join(f"{_NODES.format(c)} AS {c}_n" for c in "tex")} FROM r)
SELECT doc_id, n_chars, sha256(e) AS edited_sha256, t_root AS fingerprint, e_root AS edited_fingerprint,
  {_LIKE.format("t", "e")} AS near_edited, {_LIKE.format("t", "x")} AS near_next
FROM f
"""
