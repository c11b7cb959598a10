import random
from array import array

import pytest
import sentencepiece

from textloom.llm import pieces
from textloom.llm.pieces import MARK, Transducer, encoded, load

PATH = "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = ["", " ", "a", "  two  spaces ", "Hello world.\nNext line", "café naïve Été ñandú", "漢字 and 😀🚀​", "tab\tand\r\n", "<s> </s> <0x41> <unk>", "▁x ▁", "nul\x00in", "aaaaaaaaaaaaaaaaaaaaa", "x" * 3000, " " * 40 + "end" + " " * 17, "The the THE unbelievable antidisestablishmentarianism!!! ... --- 12345.67"]


@pytest.fixture(scope="module")
def both():
    return load(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_same_as_library(both):
    fst, library = both
    rng = random.Random(9)
    letters = "etaoin shrdlu,.éñ\nXYZ▁012-'漢😀 "
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 120))) for _ in range(1500)]
    for text in texts:
        ids = fst.encode(text)
        assert list(ids) == library.encode(text), text
        assert fst.decode(ids) == library.decode(list(ids)) == text.replace("▁", " ")
    assert fst.decode(array("i", [3 + 0xC3, 3 + 0x28])) == library.decode([3 + 0xC3, 3 + 0x28])


def test_unigram_shortest_path():
    names = ["<unk>", "▁", "a", "b", "ab", "▁ab", "ba"]
    fst = Transducer(names, [2, 1, 1, 1, 1, 1, 1], [0.0, -3.0, -4.0, -4.0, -2.0, -3.5, -1.0], merges=False)
    assert [names[k] for k in fst.encode("ab aba z")] == ["▁ab", "▁ab", "a", "▁", "<unk>"]


def test_frame(spark, both):
    rows = [(k, t, "x") for k, t in enumerate([*TEXTS, None, TEXTS[4]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, pieces string")
    got = {r["doc_id"]: r for r in encoded(df, both[0]).collect()}
    assert all(r["exact"] for r in got.values() if r["n_pieces"] is not None and "▁" not in rows[r["doc_id"]][1])
    assert got[0]["n_pieces"] == 0 and got[len(TEXTS)]["pieces"] is None and got[len(TEXTS) + 1]["pieces"] == got[4]["pieces"]
    assert encoded(df.limit(0), both[0], digest=True).count() == 0


def test_caches_are_bounded(both, monkeypatch):
    fst, library = both
    text = " ".join(f"word{k} café{k}" for k in range(300))
    monkeypatch.setattr(pieces, "CACHE_BYTES", 5000)
    monkeypatch.setattr(pieces, "PAIRS", 50)
    fst.words.clear()
    fst.words.held = 0
    assert list(fst.encode(text + " " + "x" * 3000)) == library.encode(text + " " + "x" * 3000)
    assert fst.words.held <= 5000 and len(fst.words) < 30 and fst.known_pairs <= 50
    assert all(len(fst.words.path(w)) for w in ("a", MARK, "漢"))


def test_normaliser_is_a_machine():
    squeeze = pieces.Normaliser(" ", {ord(MARK): " "}, True)
    assert squeeze("  a▁ b  ") == " a b" and squeeze("   ") == "" and pieces.Normaliser("", {}, False)(" a ") == " a "
