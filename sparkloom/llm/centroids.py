"""Centroid clustering: plain Lloyd rounds over integer vectors.

A vector is kept if it has exactly DIMS components, none of them null, NaN or infinite; each component x becomes the integer
floor(SCALE * x), x as a double. Centroids start as the K kept vectors whose ids have the smallest hashes. A round broadcasts the
centroids (K * DIMS integers); tasks give each vector the centroid of the least squared distance, of equal ones the lowest number,
and add up their vectors by centroid; one row for each centroid and task is shuffled and summed. A centroid becomes the exact
floor(sum / count) of its vectors; one without vectors stays. Every round reads the vectors anew and in full: nothing is stored
or moved but sums.

A null vector isn't kept; a null id has no hash, so its vector starts a centroid after those with one. Repeated rows count each, and
equal ids start centroids in the order of their vectors. Fewer than K kept vectors start as many centroids; none give no rows.
Components beyond plus or minus 2^62 count as that; a distance or sum of distances beyond 2^63 - 1 is given as that, though nearest
centroids are found exactly. Columns besides id and vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shipped, table

K, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
MOST = (1 << 63) - 1
#: Components up to here have squared distances that fit 64 bits; others are counted in Python's integers.
_FITS, _FAR = 1 << 27, float(1 << 62)
#: Vectors whose differences from one centroid are held at once.
_SLICE = 8192


def integers(vectors: list[np.ndarray], scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of vectors of one length, as 64-bit integers; bounded by 2^62 on both sides."""
    with np.errstate(over="ignore"):
        scaled = np.floor(np.asarray(vectors, np.float64) * scale)
    far = np.abs(scaled) >= _FAR
    out = np.where(far, 0, scaled).astype(np.int64)
    out[far] = np.where(scaled[far] > 0, 1 << 62, -(1 << 62))
    return out


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's centroid and its squared distance (an integer of any size where vectors are large); of equal ones the lowest number."""
    large = np.abs(vectors).max(initial=0) > _FITS or np.abs(centroids).max(initial=0) > _FITS
    if large:
        vectors, centroids = vectors.astype(object), centroids.astype(object)
    distances = np.empty((len(vectors), len(centroids)), object if large else np.int64)
    for k, c in enumerate(centroids):
        for at in range(0, len(vectors), _SLICE):
            apart = vectors[at : at + _SLICE] - c
            distances[at : at + _SLICE, k] = (apart * apart).sum(axis=1)
    first = distances.argmin(axis=1)  # the first of equal ones
    return first, distances[np.arange(len(vectors)), first]


def kept(df: DataFrame, vector: str, dims: int = DIMS) -> DataFrame:
    """The rows whose vectors have `dims` components, all finite; the vector as doubles."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where((F.size(F.col(vector)) == dims) & finite).withColumn(vector, v)


def start(vectors: DataFrame, k: int = K, scale: int = SCALE, seed: int = SEED) -> np.ndarray:
    """vectors: id, vector. The k of the least sha256 of `seed:id`: k rows come to the driver."""
    hashed = vectors.select("vector", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("hash"))
    first = hashed.orderBy(F.col("hash").asc_nulls_last(), "vector").limit(k).collect()
    return integers([x["vector"] for x in first], scale) if first else np.zeros((0, 0), np.int64)


def sums(vectors: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> DataFrame:
    """cluster, n, s0, s1, ...: the exact sums of each centroid's vectors."""
    spark, (k, dims) = vectors.sparkSession, centroids.shape
    shipped(spark)
    held = spark.sparkContext.broadcast(centroids)
    columns = [f"s{i}" for i in range(dims)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for batch in batches:
            if len(batch):
                own = integers(list(batch["vector"]), scale)
                at, _ = nearest(own, held.value)
                n += np.bincount(at, minlength=k)
                for c in np.unique(at):
                    of = own[at == c]
                    total[c] += (of >> 32).sum(axis=0).astype(object) * (1 << 32) + (of & 0xFFFFFFFF).sum(axis=0).astype(object)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": some, "n": n[some]} | {c: [Decimal(int(x)) for x in total[some, i]] for i, c in enumerate(columns)})

    schema = "cluster int, n long, " + ", ".join(f"{c} decimal(38,0)" for c in columns)
    parts = vectors.select("vector").mapInPandas(run, schema)
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns))


def moved(centroids: np.ndarray, summed: DataFrame) -> np.ndarray:
    """The centroids after a round: at most one row for each comes to the driver."""
    out = centroids.copy()
    for row in summed.collect():
        out[row["cluster"]] = [int(s) // row["n"] for s in row[2:]]
    return out


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> np.ndarray:
    """vectors: id, vector (see kept). The centroids after the last round."""
    centroids = start(vectors, k, scale, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(centroids, sums(vectors, centroids, scale))
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> DataFrame:
    """id, cluster, distance: each vector's nearest centroid."""
    spark = vectors.sparkSession
    shipped(spark)
    held = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) and len(held.value):
                at, apart = nearest(integers(list(batch["vector"]), scale), held.value)
                yield pd.DataFrame({"id": batch["id"], "cluster": at.astype(np.int32), "distance": np.minimum(apart, MOST).astype(np.int64)})

    ids = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "vector").mapInPandas(run, f"id {ids}, cluster int, distance long")


def _bounded_sum(distance: Column) -> Column:
    return F.least(F.sum(distance.cast("decimal(19,0)")), F.lit(Decimal(MOST)).cast("decimal(38,0)")).cast("long")


def inertias(assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cluster, cluster_inertia), one row for each cluster, and (inertia), one row."""
    by = assigned.groupBy("cluster").agg(_bounded_sum(F.col("distance")).alias("cluster_inertia"))
    return by, by.agg(_bounded_sum(F.col("cluster_inertia")).alias("inertia"))


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vectors: id, vector (see kept). id, cluster, distance, cluster_inertia, inertia, centroid (the integers)."""
    spark = vectors.sparkSession
    centroids = fit(vectors, k, rounds, scale, seed)
    assigned = assign(vectors, centroids, scale)
    by, total = inertias(assigned)  # of at most k rows, so the joins are broadcast
    named = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cluster int, centroid array<long>")
    return assigned.join(F.broadcast(by.crossJoin(total)), "cluster").join(F.broadcast(named), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = kept(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "vector")
    sha = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return cluster(vectors).select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", sha.alias("centroid_sha256"))


def _sql() -> str:
    def assigned(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (SELECT v.r, k.k, list_sum(list_transform(list_zip(v.c, k.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
  FROM v, k{k} AS k QUALIFY row_number() OVER (PARTITION BY v.r ORDER BY d, k.k) = 1)"""

    def after(k: int) -> str:
        return f"""s{k} AS (SELECT a.k, i, sum(v.c[i]) AS s, count(*)::HUGEINT AS n FROM a{k - 1} AS a JOIN v USING (r), range(1, {DIMS + 1}) AS t(i) GROUP BY a.k, i),
k{k} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c FROM k{k - 1} AS o LEFT JOIN
  (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY k) AS m USING (k))"""

    rounds = ",\n".join(f"{after(k)},\n{assigned(k)}" for k in range(1, ROUNDS + 1))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::HUGEINT) AS c
  FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: isfinite(x))) = {DIMS}),
k0 AS MATERIALIZED (SELECT row_number() OVER w - 1 AS k, c FROM v WINDOW w AS (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, c) QUALIFY row_number() OVER w <= {K}),
{assigned(0)},
{rounds}
SELECT v.vec_id, a.k::INT AS cluster, a.d::BIGINT AS distance, sum(a.d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(k.c, ',')) AS centroid_sha256
FROM a{ROUNDS} AS a JOIN v USING (r) JOIN k{ROUNDS} AS k ON k.k = a.k
"""


SQL = _sql()
