import math
import random
import re
from collections import Counter, defaultdict

import pytest

from textloom.llm import kneser_ney

SCHEMA = "doc_id long, text string, shard string, n long"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(train, texts, order):
    """(n_tokens, n_known, base, score) of each text, with dictionaries."""
    single, top = Counter(), Counter()
    padded = lambda text: [*["<s>"] * (order - 1), *tokens(text)]
    for text in train:
        own = padded(text)
        single.update(tokens(text))
        top.update(tuple(own[k : k + order]) for k in range(len(own) - order + 1))
    n, v = sum(single.values()), len(single)
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    less = {k: kneser_ney.discounts([sum(c == j for c in own.values()) for j in (1, 2, 3, 4)]) for k, own in levels.items()}
    total, after = Counter(), defaultdict(Counter)
    for k, own in levels.items():
        for g, c in own.items():
            total[k, g[:-1]] += c
            after[k, g[:-1]][min(c, 3)] += 1

    def p(gram):
        k, context = len(gram), gram[:-1]
        lower = p(gram[1:]) if k > 1 else 1 / (v + 1)
        if not total[k, context]:
            return lower
        c = levels[k][gram]
        return (max(c - less[k][min(c, 3)], 0) + sum(less[k][j] * after[k, context][j] for j in (1, 2, 3)) * lower) / total[k, context]

    out = []
    for text in texts:
        own = padded(text)
        score = sum(math.log10(p(tuple(own[k : k + order]))) for k in range(len(own) - order + 1))
        out.append((len(tokens(text)), sum(single[t] > 0 for t in tokens(text)), sum(math.log10((single[t] + 1) / (n + v + 1)) for t in tokens(text)), score))
    for g in list(top)[:6]:
        assert sum(p((*g[:-1], b)) for b in [*single, "never seen"]) == pytest.approx(1)
    return n, out


@pytest.mark.parametrize(("order", "per_shard"), [(2, 50), (3, 50), (3, 2_000_000), (4, 500)])
def test_equals_brute_force(spark, monkeypatch, order, per_shard):
    monkeypatch.setattr(kneser_ney, "SHARD_KEYS", per_shard)
    rng = random.Random(8)
    word = lambda: rng.choice(["Sun", "été", "of", "a", "run", "漢"]) + str(int(rng.expovariate(0.3)))
    texts = [" ".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(200)] + [None, "", " \n", "zzz yyy", "a1 " * 20_000, "dup dup", "dup dup"]
    train = [t for k, t in enumerate(texts) if k % 3]
    frame = lambda ts: spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(ts)], SCHEMA).repartition(3)
    model = kneser_ney.fit(frame(train), order=order)
    got = sorted(map(tuple, kneser_ney.scored(frame(texts), model).collect()))
    n, want = brute(train, texts, order)
    for row, (size, known, base, score) in zip(got, want, strict=True):
        assert row[1:4] == (size, known, n)
        assert row[4] == pytest.approx(base) and row[5] == pytest.approx(score)


def test_saved_twice(tmp_path):
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 1 << 64, 5000, dtype=np.uint64)
    counts = [np.arange(5000), np.arange(5000) % 3]
    for _ in range(2):
        kneser_ney.save_table(str(tmp_path), "t0", keys, counts)
    found = kneser_ney.table_counts(str(tmp_path), "t0", np.append(keys, [np.uint64(7)]), 2)
    assert (found[:, :-1] == counts).all() and not found[:, -1].any()
    assert not kneser_ney.table_counts(str(tmp_path), "none", keys, 2).any()


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = kneser_ney.fit(none)
    assert kneser_ney.scored(none, model).count() == 0
    row = kneser_ney.scored(spark.createDataFrame([(1, "a b", "x", 1)], SCHEMA), model).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (3, 0, 0, 0.0, 0.0)
