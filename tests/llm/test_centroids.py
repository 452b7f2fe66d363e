import hashlib
import math
import random

import numpy as np
import pytest

from sparkloom.llm import centroids

NONE = "id long, vector array<double>"


def brute(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda x: (x[0] is None, hashlib.sha256(f"1:{x[0]}".encode()).hexdigest() if x[0] is not None else "", x[1]))[:k]
    own = [v for _, v in first]
    apart = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    place = lambda v: min((apart(v, c), j) for j, c in enumerate(own))
    for _ in range(rounds):
        at = [place(v)[1] for _, v in kept]
        own = [[sum(x) // len(x) for x in zip(*(v for (_, v), a in zip(kept, at, strict=True) if a == j), strict=True)] or c for j, c in enumerate(own)]
    told = [(i, *place(v)) for i, v in kept]
    of = {j: sum(d for _, d, a in told if a == j) for j in range(len(own))}
    total = sum(of.values())
    most = (1 << 63) - 1
    return sorted(((i, a, min(d, most), min(of[a], most), min(total, most), own[a]) for i, d, a in told), key=str)


def got(spark, rows):
    df = spark.createDataFrame(rows, NONE).repartition(3)
    done = centroids.cluster(centroids.kept(df, "vector"))
    return sorted(((x["id"], x["cluster"], x["distance"], x["cluster_inertia"], x["inertia"], x["centroid"]) for x in done.collect()), key=str)


def vectors(n, seed=1):
    r = random.Random(seed)
    middle = [[r.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    return [(i, [x + r.gauss(0, 0.3) for x in r.choice(middle)]) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 10, 120])
def test_clusters_against_brute_force(spark, n):
    rows = vectors(n)
    assert got(spark, rows) == brute(rows)


def test_nulls_ties_and_large_numbers(spark):
    rows = vectors(40, 2)
    odd = [(None, rows[0][1]), (None, rows[1][1]), (3, rows[3][1]), (3, rows[4][1]), (50, None), (51, []), (52, [1.0] * 63), (53, [1.0] * 63 + [None]), (54, [float("nan")] + [1.0] * 63), (55, [float("inf")] + [1.0] * 63)]
    tied = [(60 + i, [float(i % 2)] * 64) for i in range(20)]
    assert got(spark, rows + odd + tied) == brute(rows + odd + tied)
    large = [(100 + i, [r * 1e7 for r in rows[i][1]]) for i in range(20)] + [(200, [1e12] + [0.0] * 63), (201, [3e7] + [0.0] * 63)]
    assert got(spark, rows + large) == brute(rows + large)
    assert len(got(spark, [*rows, (1, [1.7e308] * 64)])) == 41


def test_slices_and_ties_by_number(monkeypatch):
    monkeypatch.setattr(centroids, "_SLICE", 3)
    own = np.array([[0, 0], [2, 0], [0, 0]])
    at, apart = centroids.nearest(np.array([[1, 0]] * 8 + [[5, 1]]), own)
    assert at.tolist() == [0] * 8 + [1] and apart.tolist() == [1] * 8 + [10]


def test_extra_columns_and_types(spark):
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors(30)], "id int, vector array<float>, cluster string")
    assert centroids.cluster(centroids.kept(df, "vector")).count() == 30
