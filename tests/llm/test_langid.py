import random

import numpy as np
from pyspark.sql import functions as F

from textloom.llm.langid import CHUNK, _forward, chunked, fit, gradients, identify, new_network, pooled

SCHEMA = "doc_id long, text string, lang string, score double, label string"


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    net = new_network(["a", "b", "c"], 3, rng)
    for k, part in enumerate(("table", "inner", "out", "bias")):
        setattr(net, part, getattr(net, part).astype(np.float64))
    chunks, target = rng.integers(0, 256, (6, 4)).astype(np.uint8), rng.integers(0, 3, 4)
    weight = rng.random((6, 4))
    _, grads = gradients(net, chunks, target, weight)
    for part, grad in zip((net.table, net.inner, net.out, net.bias), grads):
        places = np.argwhere(np.abs(grad) > 1e-4)
        for at in map(tuple, places[rng.integers(0, len(places), 5)]):
            was, step = part[at], 1e-2
            part[at] = was + step
            up = gradients(net, chunks, target, weight)[0]
            part[at] = was - step
            down = gradients(net, chunks, target, weight)[0]
            part[at] = was
            assert abs((up - down) / (2 * step) - grad[at]) < 2e-3


def test_layers_read_both_ways():
    net = new_network(["a", "b"], 4, np.random.default_rng(2))
    chunks = np.full((8, 1), 101, np.uint8)
    base = _forward(net, chunks)
    first, last = chunks.copy(), chunks.copy()
    first[0], last[-1] = 200, 200
    assert np.abs(_forward(net, first)[-1] - base[-1]).max() > 0 and np.abs(_forward(net, last)[0] - base[0]).max() > 0


def test_held_out(spark):
    rng = random.Random(7)
    syllables = {"aa": ["the", "ing", "tion", "and", "er", "of"], "bb": ["le", "eau", "ée", "que", "ment", "des"], "cc": ["sch", "ung", "der", "ü", "ein", "ß"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(k, text(lang, rng.randrange(8, 120)), lang) for k, lang in enumerate(rng.choice(list(syllables)) for _ in range(500))]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "123 --- \n", "bb"), (1003, text("cc", 30_000), None), (1004, "漢字", None), (None, text("bb", 40), None)]
    docs = spark.createDataFrame([(*r, 0.1, "x") for r in rows], SCHEMA)
    net = fit(docs, F.col("doc_id") % 3 != 0, steps=120)
    got = {r["doc_id"]: r for r in identify(docs, net).collect()}
    held = [(k, lang) for k, _, lang in rows[:500] if k % 3 == 0]
    assert sum(got[k]["lang_pred"] == lang for k, lang in held) > 0.97 * len(held)
    assert [got[k]["lang_pred"] for k in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "cc", "bb"]
    assert got[1004]["lang_pred"] in net.labels and all(0 <= r["score"] <= 1 for r in got.values())
    again = {r["doc_id"]: r["lang_pred"] for r in identify(docs.repartition(9), net).collect()}
    assert again == {k: r["lang_pred"] for k, r in got.items()}


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fit(none, F.lit(True)) is None and identify(none, None).count() == 0
    assert identify(spark.createDataFrame([(1, "text", None, 0.0, "")], SCHEMA), None).first()["lang_pred"] == "und"
    assert CHUNK % 2 == 0


def test_stretches_cover_every_byte_once():
    texts = [b"", b"a", bytes(range(97, 117)), b"x" * 10, bytes(k % 251 for k in range(333))]
    low, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    for size, reach in ((10, 0), (10, 3), (7, 20), (400, 2)):
        chunks, first = chunked(low, offsets, size, reach)
        assert chunks.shape == (size + 2 * reach, first[-1])
        for k, text in enumerate(texts):
            padded = b" " * reach + text + b" " * (size + reach)
            assert [c.tobytes() for c in chunks.T[first[k] : first[k + 1]]] == [padded[p : p + size + 2 * reach] for p in range(0, len(text), size)]
    assert chunked(low[:0], np.zeros(3, np.int64), 5, 1)[0].shape == (7, 0)


def test_pooling_is_the_same_whatever_stands_beside():
    net = new_network(["a", "b", "c"], 4, np.random.default_rng(3))
    rng = np.random.default_rng(4)
    texts = [rng.integers(32, 256, n).astype(np.uint8) for n in (0, 5, 256, 257, 5000, 0, 700)]
    together = pooled(net, np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
    for k, text in enumerate(texts):
        assert np.abs(pooled(net, text, np.array([0, len(text)])) - together[k]).max() < 1e-5
