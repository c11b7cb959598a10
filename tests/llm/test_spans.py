import random
import re

from textloom.llm.spans import LONG, MIN_SENTENCES, without_repeats

SCHEMA = "doc_id long, text string, key string, n_removed string, places int"


def split(text):
    """(start, words) of each sentence."""
    out, fresh, last = [], True, 0
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        if fresh or "\n" in text[last : m.start()]:
            out.append((m.start(), []))
        out[-1][1].append(m[0].lower())
        fresh, last = re.search(r"[.!?][\"')\]}]{0,3}$", m[0]) is not None, m.end()
    return out


def brute(rows, least):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        own = split(text or "")
        gone, found = set(), []
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                run = sum((w for _, w in own[i:j]), [])
                alone = j == i + 1 and len(run) >= max(LONG, least)
                if alone or (len(run) >= least and j - i >= MIN_SENTENCES):
                    if tuple(run) in seen or tuple(run) in found:
                        gone |= set(range(i, j))
                    found.append(tuple(run))
                    break
        seen |= set(found)
        edges = [s for s, _ in own] + [len(text or "")]
        left = (text or "")[: edges[0]] + "".join(text[edges[k] : edges[k + 1]] for k in range(len(own)) if k not in gone)
        out.append((doc, left if text is not None else None, len(own), len(gone)))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["sun", "Été", "of", "a", "run", "le"]) + str(rng.randrange(40))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(1, 9))) + rng.choice([". ", "! ", "?) ", ".\n", "\n", '." '])
    passages = ["".join(sentence() for _ in range(8)) for _ in range(5)]
    rows = [(0, None), (1, ""), (2, " \n "), (3, "one. two."), (4, passages[0]), (5, passages[0])]
    for k in range(120):
        parts = [sentence() for _ in range(rng.randrange(1, 30))]
        if k % 3 == 0:
            parts.insert(rng.randrange(len(parts)), rng.choice(passages))
        rows.append((10 + k, "  " * (k % 2) + "".join(parts)))
    rows.append((900, passages[1].replace("\n", " \n") * 3))
    rows.append((901, "long " * 30_000 + passages[2]))
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(6)
    got = without_repeats(df, min_words=8)
    assert got.columns == ["doc_id", "text", "key", "places", "n_sentences", "n_removed"]
    got = sorted(tuple(r) for r in got.select("doc_id", "text", "n_sentences", "n_removed").collect())
    assert got == brute(rows, 8)
    assert sum(r[3] for r in got) > 300


def test_repeated_ids_and_empty(spark):
    assert without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "The quick brown fox runs. It jumps over a lazy dog today."
    rows = [(1, text), (1, text), (None, text), (1, "other text here. nothing more of it at all.")]
    got = without_repeats(spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA), min_words=5)
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == sorted([("1", text), ("1", ""), ("None", ""), ("1", rows[3][1])])
