import corpus_pipeline
from textloom.llm import textkernel as tk

DOCUMENT = list(corpus_pipeline.DOCUMENT)


def test_stages(spark, tmp_path):
    """Each stage against what its rule says of the rows that it was given."""
    import random

    rng = random.Random(1)
    syllables = {"aa": ["the", "ing", "tion", "and", "er", "of"], "bb": ["le", "eau", "ée", "que", "ment", "des"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 5)))
    line = lambda lang, n: " ".join(word(lang) for _ in range(n)).capitalize() + "."
    shared = " ".join(line("aa", 9) for _ in range(7))
    rows = []
    for k in range(160):
        lang = rng.choice(["aa", "bb"])
        text = " ".join(line(lang, rng.randrange(5, 12)) for _ in range(rng.randrange(4, 12)))
        rows.append((k, text, lang, rng.choice(["s", "s", "t", None]), len(text)))
    rows[20] = (20, rows[10][1], *rows[10][2:])
    rows[30] = (30, rows[10][1] + " Added.", *rows[10][2:])
    for k in (40, 50, 60):
        rows[k] = (k, rows[k][1] + " " + shared, *rows[k][2:])
    rows += [(500, None, "aa", "s", 0), (501, "12 34 --", None, "s", 8), (502, "", "bb", "t", 0), (503, rows[5][1], "aa", "s", 1), (503, rows[6][1], "aa", "s", 1), (None, line("bb", 30), None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "pieces":
            assert out.columns == DOCUMENT
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = [r.asDict() for r in docs.collect()]
    ids = {name: [r["doc_id"] for r in rows] for name, rows in kept.items()}
    assert {500, 501, 502}.isdisjoint(ids["language"]) and len(ids["language"]) == len(rows) - 3
    assert {20, 30, 503}.isdisjoint(ids["near_duplicates"]) and 10 in ids["near_duplicates"] and len(ids["near_duplicates"]) == len(rows) - 3 - 4
    before, after = ({r["doc_id"]: r for r in kept[n]} for n in ("near_duplicates", "repeated_passages"))
    assert after[40]["text"] == before[40]["text"] and all(len(after[k]["text"]) <= len(before[k]["text"]) - len(shared) * 0.8 for k in (50, 60))
    clean = [k for k in before if k not in (50, 60)]
    assert sum(after[k]["text"] == before[k]["text"] for k in clean) == len(clean)
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    sizes: dict = {}
    for r in kept["repeated_passages"]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    assert abs(sum(len(r["text"].split()) for r in kept["mixing"]) - 1.5 * sum(sizes.values())) < 200
    assert max(ids["mixing"].count(k) for k in set(ids["mixing"]) - {503, None}) == 2
    assert sorted(map(str, ids["pieces"])) == sorted(map(str, ids["mixing"])) and all(r["exact"] for r in kept["pieces"])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))


def test_stages_with_other_columns_and_without_rows(spark, tmp_path):
    """Names that the stages use inside come through unchanged; a table without rows gives none."""
    others = ["_key", "times", "_copies", "n_removed", "score", "id", "bucket", "c1", "place", "Size"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in others)
    texts = [f"the quick number {k} went over a hill and saw the river below it while {k * 7} others did not." for k in range(40)]
    rows = [(k, t, "aa" if k % 3 else "bb", None if k % 5 == 0 else "s", len(t), *(f"{c}{k}" for c in others)) for k, t in enumerate(texts)]
    rows += [(None, texts[3], "aa", None, None, *[None] * len(others)), (7, None, None, None, None, *[None] * len(others)), rows[9]]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(rows, schema), str(tmp_path))
        got = out.collect()
        assert got or name == "language"
        if name != "pieces":
            assert out.columns == [*DOCUMENT, *others]
            assert all(r["doc_id"] is None or r["text"] is None or [r[c] for c in others] == [f"{c}{r['doc_id']}" for c in others] for r in got)
        else:
            assert [r["pieces"] for r in got if r["n_pieces"] is None] == [None]
        none = stage(spark, spark.createDataFrame([], schema), str(tmp_path))
        assert none.columns == out.columns and none.collect() == []


def test_kernel_words_and_slices():
    import numpy as np
    import pyarrow as pa

    texts = ["a b", None, "", " x\ty ", "été", "a b"]
    data, offs = tk.buffers(pa.array(["skip", *texts, "after"]).slice(1, 6))
    assert list(np.diff(tk.words(data, offs)[2])) == [2, 0, 0, 2, 1, 2]
    sets = tk.shingle_sets(data, offs, 2)
    assert [len(s) for s in sets] == [1, 0, 0, 1, 1, 1] and sets[0] == sets[5]
    assert [hi - lo for lo, hi in tk.slices(offs, 3)] == [3, 1, 1, 1] and list(tk.slices(offs[:1])) == []
    assert list(tk.window_min(np.array([3, 1, 2, 5, 4]), 3)) == [1, 1, 2]
