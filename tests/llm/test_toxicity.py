import random

import numpy as np
from pyspark.sql import functions as F

from textloom.llm.toxicity import best_segments, fit, maximal_segments, toxicity

SCHEMA = "doc_id long, text string, score double, key string"
BAD = ["grolm", "Fnarp", "zitch"]


def test_best_segments_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes = rng.integers(0, 9, 6)
        scores = rng.normal(-0.3, 1, sizes.sum())
        first = np.concatenate([[0], np.cumsum(sizes)])
        got = best_segments(scores, first)
        for k in range(6):
            own = scores[first[k] : first[k + 1]]
            best = max([0.0, *(own[a:b].sum() for a in range(len(own)) for b in range(a + 1, len(own) + 1))])
            assert abs(got[k] - best) < 1e-9


def test_maximal_segments_are_maximal():
    """By definition: take the best segment, then the same left and right of it."""
    rng = np.random.default_rng(2)

    def recurse(s, a, b):
        found = max(((s[i:j].sum(), -i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if found[0] <= 0:
            return []
        i, j = -found[1], found[2]
        return recurse(s, a, i) + [(i, j)] + recurse(s, j, b)

    for _ in range(100):
        s = rng.normal(-0.2, 1, rng.integers(1, 25))
        assert [x[:2] for x in maximal_segments(s)] == recurse(s, 0, len(s))


def test_held_out(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.choice('abcdefghij')}{rng.choice('klmnop')}"
    rows, labels = [(0, None), (1, ""), (2, "123 456")], [(0, 0), (1, None), (None, 1)]
    for k in range(10, 700):
        words, toxic = [word() for _ in range(rng.randrange(20, 200))], int(k % 6 == 0)
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(BAD) + rng.choice(["", "!", ","]) for _ in range(4)]
        rows.append((k, " ".join(words)))
        labels.append((k, toxic))
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], SCHEMA)
    model = fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r for r in toxicity(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] < 0.3 for k, r in got.items() if k < 10)
    held = [(k, t) for k, t in labels if k and k >= 10 and k % 5 == 0]
    assert sum((got[k]["score"] >= 0.3) == bool(t) for k, t in held) > 0.98 * len(held)
    for k, t in held:
        for s in got[k]["segments"]:
            assert 0 <= s["start"] < s["end"] <= got[k]["n_words"]
    same = toxicity(docs.repartition(7), model).collect()
    assert sorted(map(str, same)) == sorted(map(str, got.values()))


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", 0.1, "x")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity(docs, fit(docs, none, F.lit(True))).first()["score"] < 0.01
    assert toxicity(docs.limit(0), fit(docs.limit(0), none, F.lit(True))).count() == 0
