import random

import pytest

from textloom.llm.mixing import flight, mixed

SCHEMA = "doc_id long, text string, source string, size long, rank string"


def wanted(sizes: dict, share=1.5, cap=2.0, weights=(5, 2, 1)) -> dict:
    """Targets by sharing and resharing the excess."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, whole = set(), share * sum(sizes.values())
    while True:
        rest, pool = whole - sum(cap * sizes[s] for s in full), sum(w[s] for s in order if s not in full)
        got = {s: cap * sizes[s] if s in full else rest * w[s] / pool for s in order}
        over = {s for s in order if s not in full and got[s] >= cap * sizes[s]}
        if not over:
            return got
        full |= over


def test_flight_keeps_totals():
    rng = random.Random(3)
    sizes, chances = [rng.randrange(1, 900) for _ in range(2000)], [rng.random() for _ in range(2000)]
    out = flight(sizes, chances, rng)
    assert sum(0 < p < 1 for p in out) <= 2
    assert sum(out) == pytest.approx(sum(chances))
    assert sum(s * p for s, p in zip(sizes, out)) == pytest.approx(sum(s * p for s, p in zip(sizes, chances)))


def test_targets_and_totals(spark):
    rng = random.Random(2)
    rows = [(k, " \n".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "a", "a", "B", "é", None, "z"])) for k in range(900)]
    rows += [(5000, None, "tiny"), (5001, "", "tiny"), (None, "one two", "tiny"), (7000, "x " * 40_000, "huge")] + [(6000, "a b c", "a")] * 50
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)
    got = mixed(df, block=64).collect()
    again = mixed(df.repartition(5), block=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = wanted(sizes)
    for source, size in sizes.items():
        own = [r for r in got if r["source"] == source]
        assert {r["source_size"] for r in own} == {size}
        assert own[0]["target"] == pytest.approx(want[source])
        assert abs(sum(r["taken"] for r in own) - want[source]) <= max(r["size"] for r in own) / 2 + 1
        assert all(r["taken"] <= 2 * r["size"] for r in own)


def test_empty(spark):
    assert mixed(spark.createDataFrame([], SCHEMA)).count() == 0
