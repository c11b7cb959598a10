import hashlib
import random

import numpy as np

from textloom.llm.fingerprint import anchors, anchors_of, edited, fingerprints, likeness, matched, render, rendered

SCHEMA = "doc_id long, text string, part string, closing long"


def brute(rows):
    """n_chars and digest of each edited text, by walking the sorted rows."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (doc, text) in enumerate(rows):
        other = edited(text, len(text), rows[(k + 1) % len(rows)][1])
        out.append((doc, len(text), hashlib.sha256(other.encode()).hexdigest()))
    return sorted(out, key=str)


def test_rows_and_edits(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abc é😀ñ\n") for _ in range(n))
    rows = [(k * 7 - 300, text(rng.choice([0, 1, 2, 9, 40, 700]))) for k in range(400)]
    rows += [(None, "null id"), (None, "another"), (5, None), (7, "same"), (7, "same"), (7, "other"), (10**17 + 1, "y" * 250_000), (-(10**17), text(30_000))]
    for part_rows in (3, 50, 100_000):
        got = fingerprints(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(7), part_rows=part_rows).collect()
        assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == brute(rows)
    same = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        same.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert len(same[7]) == 2
    long = [r for r in got if r["n_chars"] == 700]
    assert sum(r["near_edited"] for r in long) > sum(r["near_next"] for r in long)


def test_anchors_are_context_free():
    rng = random.Random(5)
    passage = bytes(rng.randrange(97, 123) for _ in range(400))
    a, b = (bytes(rng.randrange(97, 123) for _ in range(n)) + passage for n in (90, 333))
    inner = lambda t, n: {(h, p - n) for h, p in zip(*map(list, anchors(t))) if p >= n}
    assert inner(a, 90) == inner(b, 333) and len(inner(a, 90)) > 40
    assert likeness(anchors(a), anchors(a)) == 1 and likeness(anchors(b""), anchors(b"")) == 1 and likeness(anchors(a), anchors(b"")) == 0


def test_empty(spark):
    assert fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_keep_every_anchor():
    rng = random.Random(6)
    noise = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    passage = noise(400)
    a, b = noise(50_000) + passage + noise(50_000), noise(70_000) + passage + noise(9_000)
    shared = set(anchors(passage)[0].tolist()) & set(anchors(a)[0].tolist())
    assert len(shared) > 40 and shared <= set(anchors(b)[0].tolist())
    x, y = (set(anchors(t)[0].tolist()) for t in (a, b))
    assert len(x) > 15_000 and likeness(anchors(a), anchors(b)) == 2 * len(x & y) / (len(x) + len(y))
    repeated = anchors(b"the same words again. " * 3000)
    assert repeated[1][-1] > 65_900 and len(repeated[0]) > 4000
    assert render(*anchors(a)) == " ".join(f"{h:08x}:{p:x}" for h, p in zip(*(v.tolist() for v in anchors(a)), strict=True))


def naive(text, k=12, s=4):
    """Closed syncmers, window by window: the places where the least inner substring, by the same hash, is at an edge."""
    mask = (1 << 64) - 1
    led = b"\x02" * (k - 1) + text if text else b""

    def rank(part):
        x = int.from_bytes(part, "big") * 0x9E3779B97F4A7C15 & mask
        return (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & mask

    places = []
    for p in range(len(led) - k + 1):
        inner = [rank(led[p + j : p + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            places.append(max(0, p - (k - 1)))
    return places


def test_anchors_equal_brute_force_in_any_company():
    rng = random.Random(7)
    texts = [bytes(rng.choice(b"abc \n\xc3\xa9") for _ in range(n)) for n in (0, 1, 3, 4, 11, 12, 13, 200, 0, 900)]
    together = anchors_of(texts)
    assert [places.tolist() for _, places in together] == [naive(t) for t in texts]
    for text, (hashes, places) in zip(texts, together, strict=True):
        alone = anchors(text)
        assert alone[0].tolist() == hashes.tolist() and alone[1].tolist() == places.tolist()
    assert anchors_of([]) == [] and rendered(together) == [render(*a) for a in together]
    windows: dict = {}
    for text, (hashes, places) in zip(texts, together, strict=True):
        for h, p in zip(hashes.tolist(), places.tolist(), strict=True):
            windows.setdefault(h, set()).add(text[p : p + 12] if p else None)
    assert all(len(w) == 1 for w in windows.values())


def test_matched_equals_brute_force():
    """The longest common rising run of numbered occurrences, by the quadratic recurrence."""
    rng = random.Random(8)

    def number(row):
        seen: dict = {}
        out = []
        for v in row:
            seen[v] = seen.get(v, 0) + 1
            out.append((v, seen[v]))
        return out

    for _ in range(300):
        x, y = ([rng.randrange(rng.choice([2, 6, 50])) for _ in range(rng.randrange(0, 25))] for _ in range(2))
        if rng.random() < 0.5:
            y = x[: rng.randrange(0, len(x) + 1)] + y
        a, b = number(x), number(y)
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, v in enumerate(a):
            for j, w in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if v == w else max(best[i][j + 1], best[i + 1][j])
        assert matched(np.array(x, np.uint32), np.array(y, np.uint32)) == best[-1][-1]


def test_order_of_passages_counts():
    rng = random.Random(9)
    passages = [bytes(rng.randrange(97, 123) for _ in range(300)) for _ in range(12)]
    straight, turned = anchors(b"".join(passages)), anchors(b"".join(reversed(passages)))
    assert likeness(straight, turned) < 0.15
    moved = anchors(b"new words before " + b"".join(passages[:6]) + b" and between " + b"".join(passages[6:]))
    assert likeness(straight, moved) > 0.95
