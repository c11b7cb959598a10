from pyspark.sql import functions as F

from textloom.operators.tokenizers import paragraphs, tokenizer
from textloom.operators.tokens import batch, token_counts
from textloom import functions as fn

TEXTS = ["a b  c", "Hé! two\nlines\n\nmore. end", ""]
SPANNED = ["space", "char", "whitespace", "wordpunct", "treebank", "sentence"]


def test_spans_show_the_tokens(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for name in SPANNED:
        kind = tokenizer(name)
        shown = F.transform(kind.spans(F.col("text")), lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))
        for tokens, own in kind.transform(df).select("tokens", shown).collect():
            assert own == [t for t in tokens if t], name


def test_options_and_batches(spark):
    df = spark.createDataFrame([(1, "a-b--c"), (2, "x\n\n y ")], "doc_id long, text string")
    assert [r["tokens"] for r in tokenizer("regexp", pattern="-+", gaps=True).transform(df).orderBy("doc_id").collect()] == [["a", "b", "c"], ["x\n\n y "]]
    spans = tokenizer("regexp", pattern="-+", gaps=True).spans(F.col("text"))
    assert [tuple(s) for s in df.where("doc_id = 1").select(spans).first()[0]] == [(0, 1), (2, 3), (5, 6)]
    assert df.where("doc_id = 2").select(paragraphs("text")).first()[0] == ["x", "y"]
    lines = tokenizer("line", blanklines="keep")
    assert [tuple(s) for s in df.where("doc_id = 2").select(lines.spans(F.col("text"))).first()[0]] == [(0, 1), (3, 6)]
    assert batch(df, fn.space_tokenize).columns == ["doc_id", "text", "tokens"]
    assert {tuple(r) for r in token_counts(df, fn.whitespace_tokenize).collect()} == {("a-b--c", 1), ("x", 1), ("y", 1)}
