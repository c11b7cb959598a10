import random
import re

import pytest

from textloom.llm import minhash
from textloom.llm.minhash import near_duplicates

SCHEMA = "doc_id long, text string, id string, size long, bucket string"


def brute(rows, n=4, threshold=80):
    """Components by comparing every two sets of shingles."""
    sets = []
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((doc, {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()))
    parent = {doc: doc for doc, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {(doc, len(s), root(doc), doc == root(doc)) for doc, s in sets}


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "the", "Of", "moon", "xyz", "été", "run"]) + str(rng.randrange(60))
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "One"), (5, "one two three"), (6, "x" * 300_000), (7, "x" * 300_000)]
    for k in range(60):
        base = [word() for _ in range(rng.randrange(3, 160))]
        rows.append((100 + 20 * k, " ".join(base)))
        chain = base
        for j in range(rng.randrange(8)):
            chain = list(chain if k % 2 else base)
            for _ in range(rng.randrange(1, 1 + max(1, len(chain) // 30))):
                chain[rng.randrange(len(chain))] = word()
            rows.append((100 + 20 * k + 1 + j, "  ".join(chain)))
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "clash", 1, None) for d, t in rows], SCHEMA)
    got = {tuple(r) for r in near_duplicates(df, ngram=4).collect()}
    assert got == brute(rows)
    assert len({c for _, _, c, _ in got}) < len(rows) - 60


def test_empty_and_repeated(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(5, "a b c d e f", None, None, None), (5, "a b c d e f", None, None, None), (None, "a b c d e f", None, None, None), (3, "A b C d e f", None, None, None), (5, "p q r s t u", None, None, None), (2, "p q r s t u", None, None, None)]
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "component_id", "kept").collect() if r[0] is not None)
    assert got == [(2, 2, True), (3, 2, False), (5, 2, False), (5, 2, False), (5, 2, False)]


def test_large_group_of_different_copies(spark):
    rng = random.Random(12)
    base = [f"w{rng.randrange(3000)}" for _ in range(140)]
    rows = []
    for k in range(600):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame([(d, t, "x", 1, None) for d, t in rows], SCHEMA)
    assert {tuple(r) for r in near_duplicates(df, ngram=4).collect()} == brute(rows)


def brute_links(sets, threshold=80):
    return {(max(a, b), min(a, b)) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.mark.parametrize("block", [4, 4096])
def test_exact_finish_finds_every_link(spark, monkeypatch, block):
    """Copies of one original at all distances, some linked to it alone, in sizes around the threshold."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(5)
    sets = {200: set(range(400))}
    for k in range(200):
        lost, more = rng.choice([(40, 40), (0, 90), (0, 110), (70, 0), (90, 0), (20, 20), (60, 0), (24, 20)])
        sets[k] = set(range(400)) - set(rng.sample(range(400), lost)) | set(range(1000 * (k + 1), 1000 * (k + 1) + more))
    sets |= {k: set(range(5000, 5000 + k % 7 + 1)) for k in range(201, 230)}
    links = brute_links(sets)
    assert 200 < len(links) < 10_000
    code = lambda x: (x * 0x9E3779B97F4A7C15 & (1 << 64) - 1) - (1 << 63)
    members = spark.createDataFrame([(bucket, k, k) for k in sets for bucket in (7, 8)], "bucket long, id long, component long")
    items = spark.createDataFrame([(k, sorted(map(code, v))) for k, v in sets.items()], "id long, items array<long>")
    assert {tuple(r) for r in minhash._rest(members, items, 80).collect()} == links


@pytest.mark.parametrize(("edits", "n"), [(7, 500), (11, 2500)])
def test_rare_pair_among_many_variants(spark, edits, n):
    """Two documents of three edits among many of more, all in the same buckets: their link is the only one."""
    rng = random.Random(edits)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for k in range(n):
        own = list(base)
        for at in rng.sample(range(300), 3 if k < 2 else edits):
            own[at] = f"e{rng.randrange(10**9)}"
        rows.append((k, " ".join(own)))
    got = {r[0]: r[2] for r in near_duplicates(spark.createDataFrame([(d, t, "x", 1, None) for d, t in rows], SCHEMA), ngram=4).collect()}
    grams = {k: {" ".join(w[j : j + 4]) for j in range(297)} for k, w in ((k, t.split()) for k, t in rows)}
    few = {k: grams[k] for k in (0, 1, *range(2, n, 40))}
    assert (1, 0) in brute_links(few) and got[1] == got[0] == 0
    want = {(0, 0), (1, 0)} if edits == 11 else {(k, got[k]) for k in few}
    assert {(k, got[k]) for k in few if got[k] != k or k == 0} <= want
    assert all(got[a] == got[b] for a, b in brute_links(few))
