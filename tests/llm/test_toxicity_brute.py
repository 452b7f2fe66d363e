import math
import random
import re

import numpy as np
import pytest
import xxhash

from sparkloom.llm import toxicity


def found(text):
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    return {"w:" + w for w in words} | {"p:" + w[:n] for w in words for n in (4, 5, 6) if len(w) > n}


def fold(text):
    return ((xxhash.xxh64_intdigest(text.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)) % toxicity.FOLDS


def choose(rows, c, k, most):
    """The features of category c with the most evidence outside fold k, and whether they are strong."""
    own = [r for r in rows if r["fold"] != k and r["y"][c] is not None]
    n = [max(1, sum(r["y"][c] == v for r in own)) for v in (0, 1)]
    out = []
    for f in {f for r in own for f in r["f"]}:
        pos, neg = (sum(f in r["f"] for r in own if r["y"][c] == v) for v in (1, 0))
        evidence = pos * math.log((pos + 0.5) / n[1] / ((neg + 0.5) / n[0]))
        if pos >= toxicity.LEAST_TEXTS and evidence > 0:
            out.append((-evidence, f, pos / n[1] >= toxicity.STRONG_SHARE and pos / n[1] >= toxicity.STRONG_TIMES * neg / n[0]))
    return [(f, strong) for _, f, strong in sorted(out)[:most]]


def columns(texts, chosen, before):
    x = [[f in t for f, _ in chosen] + [any(s and f[0] == kind and f in t for f, s in chosen) for kind in "wp"] for t in texts]
    return np.hstack([np.array(x, float), before])


def fit(x, y, w):
    """Gradient descent to the end, plainly: the loss is convex."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b, penalty = np.zeros(x.shape[1]), np.array([toxicity.RIDGE] * (x.shape[1] - 1) + [1e-4])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ b))
        slope = x.T @ (w * (p - y)) + penalty * b
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        b = b - 0.7 * np.linalg.solve(curve, slope)
    return b


def probabilities(x, b):
    return 1 / (1 + np.exp(-(x @ b[:-1] + b[-1])))


def brute(docs, labels):
    """By doc_id the chain's probabilities: every fold fitted by itself, every row for itself."""
    rows, texts = [], dict(docs)
    for i, *y in labels:
        if i in texts:
            text = texts[i] or ""
            rows.append({"fold": fold(text), "y": y, "f": found(text)})
    every = [found(t) for _, t in docs]
    before, ahead = np.zeros((len(rows), 0)), np.zeros((len(docs), 0))
    for c in range(2):
        most = toxicity.FEATURES if c else toxicity.EARLIER
        y = np.array([r["y"][c] or 0 for r in rows], float)
        known = np.array([r["y"][c] is not None for r in rows])
        folds = np.array([r["fold"] for r in rows])

        def model(k, on, texts, others):
            chosen = choose(rows, c, k, most)
            x = columns([r["f"] for r in rows], chosen, before)
            return probabilities(columns(texts, chosen, others), fit(x[on], y[on], np.ones(on.sum())))

        out = np.zeros(len(rows))
        for k in set(folds.tolist()):
            here = folds == k
            out[here] = model(k, known & ~here, [r["f"] for r, h in zip(rows, here, strict=True) if h], before[here])
        last = model(toxicity.FOLDS, known, every, ahead)
        before, ahead = np.hstack([before, out[:, None]]), np.hstack([ahead, last[:, None]])
    return {i: tuple(p) for (i, _), p in zip(docs, ahead.tolist(), strict=True)}


@pytest.mark.parametrize("seed", [1, 2])
def test_the_chain_against_plain_fits(spark, seed):
    r = random.Random(seed)
    plain, bad, poor = ([f"{stem}{r.choice('aeiou')}{k}th".replace(str(k), "bcdfghjklm"[k % 10]) + "".join(r.choice("xyzvw") for _ in range(3)) for k in range(n)] for stem, n in (("wor", 40), ("tox", 6), ("pal", 5)))
    docs, labels = [], []
    for i in range(220):
        low, toxic = r.random() < 0.3, r.random() < 0.25
        words = [r.choice(plain) for _ in range(12)] + [r.choice(poor) for _ in range(2) if low and r.random() < 0.8] + [r.choice(bad) for _ in range(2) if toxic and r.random() < 0.9]
        r.shuffle(words)
        docs.append((i, " ".join(words)))
        if i < 160:
            labels.append((i, None if i % 17 == 0 else int(low != (r.random() < 0.05)), int(toxic)))
    docs += [(220, None), (221, ""), (222, "x" * 50_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    chain = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, low_quality int, toxic int"))
    got = {x["doc_id"]: (x["p_low_quality"], x["p_toxic"]) for x in toxicity.score(df, chain).collect()}
    want = brute(docs, labels)
    assert got.keys() == want.keys()
    for i, p in want.items():
        assert got[i] == pytest.approx(p, abs=2e-3), i
    assert max(p[1] for p in want.values()) > 0.8 > 0.2 > min(p[1] for p in want.values())
