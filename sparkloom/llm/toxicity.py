"""Toxicity by a classifier chain.

The chain predicts categories one after the other, each given as a column of 0 and 1; a model sees the features of a text and the
probabilities of the categories before its own. Each is a ridge-penalised logistic regression. What the later models are trained with
are out-of-fold probabilities: for each of FOLDS folds (equal texts in one) the features are chosen and the model is fitted without
that fold. What they are applied to are the probabilities of the models of all rows.

`labels` has one judgement of toxicity, so there is one such category, the last, which decides. The table's other judgement, quality,
is the chain's first link (low_quality). With more columns of judgements the chain is longer.

The features are the presence of whole words (`w:`) and of word beginnings of 4 to 6 letters (`p:`): for each category the ones with
the most evidence for it (FEATURES for the last category, EARLIER for the others), and whether any strong one is present.

Fitting uses at most FIT_ROWS labelled texts, those of the lowest hashes, so it costs the same at any size; scoring covers every whole
text. Equal texts of equal labels are one in the counts of features, and weigh as many as they are in the models. Null texts count as
empty, null judgements are left out of their category, repeated rows are scored each. A category without labels of both kinds, or
without features, has its share of the labels as every probability (0 without any). Other columns pass through `score`; columns of
the results' names are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, nonnull, stored, table

FIT_ROWS = 20_000
FEATURES, EARLIER, LEAST_TEXTS, FOLDS, RIDGE = 384, 64, 5, 5, 0.1
STRONG_SHARE, STRONG_TIMES = 0.04, 50
BEGINNINGS = (4, 5, 6)
#: Rows whose part of the normal matrix is made at once.
BLOCK = 2048
CATEGORIES = ("low_quality", "toxic")
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    words = set(_WORD.findall((text or "").lower()))
    return {f"w:{w}" for w in words} | {f"p:{w[:n]}" for w in words for n in BEGINNINGS if len(w) > n}


@dataclass
class Finder:
    """Which of the chosen features a text has, by one pass of an Aho-Corasick automaton."""

    chosen: list[str]

    def __post_init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        by_text: dict[str, list[tuple[bool, int]]] = {}
        for i, f in enumerate(self.chosen):
            by_text.setdefault(f[2:], []).append((f[0] == "w", i))
        for t, kinds in by_text.items():
            self.automaton.add_word(t, (len(t), kinds))
        self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[int]:
        if not self.chosen:
            return []
        low, found = (text or "").lower(), set()
        letter = lambda at: 0 <= at < len(low) and low[at].isalnum() and not low[at].isdecimal()
        for last, (n, kinds) in self.automaton.iter(low):
            if not letter(last - n):
                more = letter(last + 1)
                found.update(i for whole, i in kinds if whole != more)
        return sorted(found)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """The coefficients, the last one the intercept, by Newton's method; a step that makes things worse is halved."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-4
    loss = lambda z, b: (weight * (np.logaddexp(0, z) - y * z)).sum() + (penalty * b * b).sum() / 2
    z = x @ b
    now = loss(z, b)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        curve = weight * p * (1 - p)
        normal = sum((x[i : i + BLOCK] * curve[i : i + BLOCK, None]).T @ x[i : i + BLOCK] for i in range(0, len(x), BLOCK))
        step = np.linalg.solve(normal + np.diag(penalty), x.T @ (weight * (y - p)) - penalty * b)
        for _ in range(30):
            after = loss(x @ (b + step), b + step)
            if after <= now:
                break
            step /= 2
        else:
            break
        b, z, before, now = b + step, x @ (b + step), now, after
        if before - now < 1e-6 * max(1.0, before):
            break
    return b


def probability(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ b[:-1] + b[-1], -30, 30)))


@dataclass
class Chosen:
    """The features of a model, and which of them are strong: in STRONG_SHARE of the category's texts, and STRONG_TIMES as often as in others."""

    features: list[str] = field(default_factory=list)
    strong: list[bool] = field(default_factory=list)

    def columns(self, present: np.ndarray, place: dict[str, int]) -> np.ndarray:
        """The columns of `present` for these features, and whether any strong word, and any strong beginning, is there."""
        x = present[:, [place[f] for f in self.features]]
        kinds = [np.array([s and f[0] == kind for f, s in zip(self.features, self.strong, strict=True)], bool) for kind in "wp"]
        return np.hstack([x, *(x[:, on].any(axis=1)[:, None] for on in kinds)])


@dataclass
class Link:
    """A category's model of all rows; without coefficients its share of the labels."""

    category: str
    chosen: Chosen
    coefficients: np.ndarray | None
    share: float


def _matrix(present: list, n: int) -> np.ndarray:
    x = np.zeros((len(present), n), bool)
    for r, on in enumerate(present):
        x[r, list(on)] = True
    return x


@dataclass
class Chain:
    links: list[Link]

    def __post_init__(self):
        self.features = sorted({f for x in self.links for f in x.chosen.features})
        self.place = {f: i for i, f in enumerate(self.features)}

    def predict(self, present: list[list[int]]) -> np.ndarray:
        """The categories' probabilities: one row for each text's features."""
        x, p = _matrix(present, len(self.features)), np.zeros((len(present), 0))
        for link in self.links:
            if link.coefficients is None:
                own = np.full(len(x), link.share)
            else:
                own = probability(np.hstack([link.chosen.columns(x, self.place), p]), link.coefficients)
            p = np.hstack([p, own[:, None]])
        return p


def _counted(x: np.ndarray, before: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows as one, with the sum of their weights: most texts have few of the features. Rows are compared as bits, and only different ones become numbers, as the driver holds them."""
    bits = np.ascontiguousarray(np.hstack([np.packbits(x, axis=1), np.ascontiguousarray(before).view(np.uint8).reshape(len(x), 8 * before.shape[1]), y.astype(np.uint8)[:, None]]))
    _, first, which = np.unique(bits.view(np.dtype((np.void, bits.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return np.hstack([x[first], before[first]]), y[first], np.bincount(which, weights=weight)


def chained(categories: list[str], chosen: dict[tuple[str, int], Chosen], universe: list[str], rows: list[tuple[int, list[int | None], int, list[int]]]) -> Chain:
    """chosen: by category and left-out fold (FOLDS: none); rows: (fold, labels, weight, features present by place in the universe)."""
    fold, weight = np.array([r[0] for r in rows], int), np.array([r[2] for r in rows], float)
    x, place = _matrix([r[3] for r in rows], len(universe)), {f: i for i, f in enumerate(universe)}
    before, links = np.zeros((len(rows), 0)), []
    for c, category in enumerate(categories):
        known = np.array([r[1][c] is not None for r in rows], bool)
        y = np.array([r[1][c] or 0 for r in rows], float)

        def model(k: int, on: np.ndarray) -> tuple[np.ndarray | None, float]:
            share = float((y * weight)[on].sum() / weight[on].sum()) if on.any() else 0.0
            return (logistic(*_counted(chosen[category, k].columns(x[on], place), before[on], y[on], weight[on])) if 0 < share < 1 and chosen[category, k].features else None), share

        out = np.zeros(len(rows))
        for k in sorted(set(fold.tolist())):
            (b, share), left = model(k, known & (fold != k)), fold == k
            out[left] = share if b is None else probability(np.hstack([chosen[category, k].columns(x[left], place), before[left]]), b)
        b, share = model(FOLDS, known)
        links.append(Link(category, chosen[category, FOLDS], b, share))
        before = np.hstack([before, out[:, None]])
    return Chain(links)


def judgements(labels: DataFrame) -> DataFrame:
    """The table labels: doc_id and the chain's categories that it tells."""
    found = [(1 - F.col("quality")).alias("low_quality")] if "quality" in labels.columns else []
    return labels.select("doc_id", *found, "toxic")


def training_rows(docs: DataFrame, labels: DataFrame, categories: list[str], fit_rows: int) -> DataFrame:
    """text, fold, categories, n: at most fit_rows different labelled texts, those of the lowest hashes, and how often they occur."""
    cast = [F.col(c).cast("int").alias(c) for c in categories]
    told = labels.where(F.col("doc_id").isNotNull() & F.coalesce(*categories).isNotNull()).select("doc_id", *cast).orderBy(F.xxhash64("doc_id"), "doc_id", *categories).limit(fit_rows)
    joined = docs.select("doc_id", nonnull(F.col("text")).alias("text")).join(F.broadcast(told), "doc_id")  # fit_rows bounds it
    rows = joined.withColumns({"_a": F.xxhash64("text"), "_b": F.xxhash64("text", F.lit(1))}).groupBy("_a", "_b", *categories).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    rows = stored(rows.withColumn("fold", F.pmod("_a", F.lit(FOLDS)).cast("int")), "labelled")
    if rows.count() <= fit_rows:  # a doc_id can have many texts
        return rows
    cut = rows.select("_a").orderBy("_a").limit(fit_rows).agg(F.max("_a")).first()[0]
    return rows.where(F.col("_a") < cut)


def _choose(rows: DataFrame, categories: list[str]) -> dict[tuple[str, int], Chosen]:
    """For each category and left-out fold (FOLDS: none) the features with the most evidence in the other folds."""
    names = [f"{kind}{c}" for c in range(len(categories)) for kind in ("pos", "neg")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, 250) for b in batches for at in range(0, len(b), 250)):
            seen: dict[tuple[str, int], list[int]] = {}
            labels = list(zip(*(part.column(c).to_pylist() for c in categories), strict=True))
            for fold, ys, text in zip(part.column("fold").to_pylist(), labels, part.column("text").to_pylist(), strict=True):
                on = [2 * c + 1 - y for c, y in enumerate(ys) if y is not None]
                for f in features(text):
                    counts = seen.setdefault((f, fold), [0] * len(names))
                    for i in on:
                        counts[i] += 1
            keys = [*seen]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), *(pa.array([v[i] for v in seen.values()], pa.int64()) for i in range(len(names)))], names=["feature", "fold", *names])

    total = rows.groupBy("fold").agg(*(F.count_if(F.col(c) == y).alias(f"{kind}{i}") for i, c in enumerate(categories) for kind, y in (("pos", 1), ("neg", 0)))).collect()
    counts = map_arrow(rows.select("fold", "text", *categories), count, "feature string, fold int, " + ", ".join(f"{n} long" for n in names))
    # a column for each left-out fold, and for none
    sums = [F.sum(F.when(F.col("fold") != k, F.col(n)).otherwise(0)).alias(f"{n}_{k}") for n in names for k in range(FOLDS + 1)]
    counts = stored(counts.groupBy("feature").agg(*sums).where(F.greatest(*(F.col(f"pos{c}_{FOLDS}") for c in range(len(categories))), F.lit(0)) >= LEAST_TEXTS), "features")
    asked, n = None, {}
    for c, category in enumerate(categories):
        for k in range(FOLDS + 1):
            n[category, k] = [max(1, sum(r[f"{kind}{c}"] for r in total if r["fold"] != k)) for kind in ("neg", "pos")]
            pos, neg = F.col(f"pos{c}_{k}"), F.col(f"neg{c}_{k}")
            evidence = pos * F.log((pos + 0.5) / n[category, k][1] / ((neg + 0.5) / n[category, k][0]))
            one = counts.where(pos >= LEAST_TEXTS).select(F.lit(category).alias("category"), F.lit(k).alias("k"), "feature", pos.alias("pos"), neg.alias("neg"), evidence.alias("evidence")).where("evidence > 0")
            one = one.orderBy(F.desc("evidence"), "feature").limit(FEATURES if c == len(categories) - 1 else EARLIER)
            asked = one if asked is None else asked.unionByName(one)
    out = {x: Chosen() for x in n}
    for r in sorted(asked.collect(), key=lambda r: (-r["evidence"], r["feature"])):
        at, (of_neg, of_pos) = out[r["category"], r["k"]], n[r["category"], r["k"]]
        at.features.append(r["feature"])
        at.strong.append(r["pos"] / of_pos >= STRONG_SHARE and r["pos"] / of_pos >= STRONG_TIMES * r["neg"] / of_neg)
    return out


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, categories: tuple[str, ...] | None = None) -> Chain:
    """A chain from docs (doc_id, text) and labels (doc_id and the categories in their order; those of CATEGORIES that it has)."""
    names = list(categories or [c for c in CATEGORIES if c in labels.columns])
    rows = training_rows(docs, labels, names, fit_rows)
    chosen = _choose(rows, names)
    universe = sorted({f for x in chosen.values() for f in x.features})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(universe)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("fold", "n", *names)), pa.array([finder(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], names=["fold", "n", *names, "found"])

    schema = "fold int, n long, " + ", ".join(f"{c} int" for c in names) + ", found array<int>"
    found = map_arrow(rows.select("fold", "n", *names, "text"), find, schema).groupBy("fold", *names, "found").agg(F.sum("n").alias("n")).collect()  # fit_rows bounds it
    told = sorted(((r["fold"], [r[c] for c in names], r["n"], r["found"]) for r in found), key=str)
    return chained(names, chosen, universe, told)


def score(df: DataFrame, chain: Chain, text: str = "text", least: float = 0.5) -> DataFrame:
    """df with the categories' probabilities (p_<category>) and toxic, whether the last reaches `least`."""
    names = [*(f"p_{x.category}" for x in chain.links), "toxic"]
    kept = [c for c in df.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(chain.features)
        for batch in batches:
            p = chain.predict([finder(t) for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(p[:, i]) for i in range(p.shape[1])), pa.array(p[:, -1] >= least)], names=[*kept, *names])

    schema = df.select(*kept).schema
    for c in names[:-1]:
        schema = schema.add(c, "double")
    return map_arrow(df.select(*kept), run, schema.add("toxic", "boolean"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, judgements(table(spark, sf_dir, "labels")))).drop("text")
