"""Margins, smoothing and cut of the quality selection against plain loops over single features."""

import math
import random
from collections import Counter

import pytest

from tidemark.llm.common import ship_package
from tidemark.llm.quality import PRIORS, features, quality_selection


def brute(rows, labels):
    """margin by row's place, k: rows are (id, text), labels id -> clean."""
    feats = [features(t or "").tolist() for _, t in rows]
    raw, target = Counter(), Counter()
    for (i, _), f in zip(rows, feats, strict=True):
        raw.update(f)
        if labels.get(i):
            target.update(f)
    n_raw, n_target = sum(raw.values()), sum(target.values())

    def ratio(f, hit, prior):
        own, total = Counter(f), 0.0
        for b in f:
            if raw[b] > own[b]:
                p_raw = (raw[b] - own[b]) / max(1, n_raw - len(f))
                seen = target[b] - own[b] if hit else target[b]
                total += math.log((seen / p_raw + prior) / (n_target - (len(f) if hit else 0) + prior))
        return total

    judged = [(labels[i], f) for (i, _), f in zip(rows, feats, strict=True) if i in labels and f]
    sums = {prior: sum(ratio(f, True, prior) for clean, f in judged if clean) for prior in PRIORS}
    prior = max(PRIORS, key=lambda p: sums[p])
    scores = sorted((ratio(f, clean, prior) / len(f), clean) for clean, f in judged)
    cuts = sorted({s for s, _ in scores})  # what is kept is all from one of these up
    right = {c: sum((s >= c) == clean for s, clean in scores) for c in cuts}
    best = next(c for c in cuts if right[c] == max(right.values()))
    below = [s for s, _ in scores if s < best]
    cut = (best + below[-1]) / 2 if below else best
    return [ratio(f, bool(labels.get(i)), prior) - cut * len(f) for (i, _), f in zip(rows, feats, strict=True)]


@pytest.mark.parametrize("seed", [1, 2])
def test_margins(spark, seed):
    ship_package(spark)
    rng = random.Random(seed)
    word = lambda kind: f"{kind}{int(rng.paretovariate(0.8)) % 40}"
    text = lambda share: " ".join(word("good" if rng.random() < share else "bad") + rng.choice(["", ",", "."]) for _ in range(rng.choice([1, 8, 40])))
    rows = [(i, text(0.8 if i % 3 else 0.3)) for i in range(60)] + [(60, None), (61, ""), (None, text(0.8))]
    quality = {i: (1 if i % 3 else 0) for i in range(0, 50, 2)} | {61: 1}
    labels = spark.createDataFrame([(i, q, int(i == 4)) for i, q in quality.items()], "doc_id bigint, quality int, toxic int")
    got = quality_selection(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), labels).collect()
    margin = {r["id"]: r["margin"] for r in got}
    for (i, _), want in zip(rows, brute(rows, {i: q == 1 and i != 4 for i, q in quality.items()}), strict=True):
        assert margin[i] == pytest.approx(want, abs=1e-6), i
    k = sum(r["margin"] >= 0 for r in got)
    order = sorted(got, key=lambda r: -r["sample_key"])
    assert {r["id"] for r in got if r["kept"]} == {r["id"] for r in order[:k]}
    noise = [r["sample_key"] - r["margin"] for r in got]
    assert -2 < min(noise) and 0 < sum(noise) / len(noise) < 1.2  # the mean of Gumbel noise is 0.577
