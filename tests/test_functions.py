"""Small cases with known results, edge strings, and invariants against independent models."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom import functions as fn
from textloom.functions import aliases, sentences
from textloom.functions.sexpr import groups
from textloom.functions.syllables import onset_syllables
from textloom.functions.tiling import segments, similarities

EDGES = ["", " ", "a", "a" * 10_000, "\x00", "😀🚀", "​", "café", "  a  b ", " x y", "a\r\nb\r\n\r\nc"]


def values(spark, function, inputs, kind="string"):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], f"k int, x {kind}").repartition(1)
    return [r[0] for r in df.orderBy("k").select(function(F.col("x"))).collect()]


GOLDEN = [
    (fn.word_tokenize, "Hello, world. It costs $5.00.", "Hello|,|world|.|It|costs|$|5.00|."),
    (fn.word_tokenize, 'He said "hello".', "He|said|``|hello|''|."),
    (fn.word_tokenize, "I can't do it.", "I|ca|n't|do|it|."),
    (fn.word_tokenize, "They've gone.", "They|'ve|gone|."),
    (fn.word_tokenize, "Wait... what?", "Wait|...|what|?"),
    (fn.word_tokenize, "'Tis gonna be cannot", "'T|is|gon|na|be|can|not"),
    (fn.word_tokenize, "a -- b--c [x] <y>", "a|--|b|--|c|[|x|]|<|y|>"),
    (fn.word_tokenize, "1,234.56 3:45 a:b", "1,234.56|3:45|a|:|b"),
    (lambda c: fn.word_tokenize(c, convert_parentheses=True), "a (b) {c}", "a|-LRB-|b|-RRB-|-LCB-|c|-RCB-"),
    (fn.word_tokenize, "I am here. he left.", "I|am|here.|he|left|."),
    (aliases.word_tokenize_batch, "I am here. he left.", "I|am|here|.|he|left|."),
    (fn.sent_tokenize, 'He said "Stop." She left.', 'He said "Stop."|She left.'),
    (fn.sent_tokenize, "What?! No way. ok", "What?|!|No way.|ok"),
    (fn.sent_tokenize, "Hello!!! World", "Hello!|!|!|World"),
    (fn.sent_tokenize, "Wait... what?", "Wait... what?"),
    (fn.sent_tokenize, "(He left.) She stayed.", "(He left.)|She stayed."),
    (fn.sent_tokenize, "a\n\nb\n\nc", "a\n\nb\n\nc"),
    (fn.sent_tokenize, "Mr. Smith went home. He left.", "Mr. Smith went home.|He left."),
    (fn.sent_tokenize, "J. R. R. Tolkien wrote it. He was British.", "J. R. R. Tolkien wrote it.|He was British."),
    (fn.sent_tokenize, "It cost $3.5 million. Sales rose 12%.", "It cost $3.5 million.|Sales rose 12%."),
    (fn.sent_tokenize, "He works at the U.N.", "He works at the U.N."),
    (fn.casual_tokenize, "Hey @user how are you?", "Hey|@user|how|are|you|?"),
    (fn.casual_tokenize, "Call +1 (555) 123-4567", "Call|+1 (555) 123-4567"),
    (fn.casual_tokenize, "tags #nlp :) &lt;3 &#8364; x&#x80;", "tags|#nlp|:)|<3|€|x|€"),
    (lambda c: fn.casual_tokenize(c, reduce_len=True), "sooooo cool", "sooo|cool"),
    (lambda c: fn.casual_tokenize(c, strip_handles_=True), "@me hello a@b.com", "hello|a@b.com"),
    (lambda c: fn.casual_tokenize(c, preserve_case=False), "LOUD :D Word", "loud|:D|word"),
    (fn.toktok_tokenize, "It costs $5.00.", "It|costs|$|5.00|."),
    (fn.toktok_tokenize, "See http://x.org/a?b=c, or: café?", "See|http://x.org/a?b=c|,|or|:|café|?"),
    (fn.toktok_tokenize, 'He said "so."', 'He|said|"|so|.|"'),
    (lambda c: fn.mwe_text(c, [["a", "little", "bit"], ["a", "little"]]), "a little bit of a little", "a_little_bit|of|a_little"),
    (lambda c: fn.mwe_text(c, [["a", "b"]]), "aa b a bb a b", "aa|b|a|bb|a_b"),
    (fn.sexpr_tokenize, "(a b (c d)) e f (g)", "(a b (c d))|e|f|(g)"),
    (lambda c: fn.sexpr_tokenize(c, strict=False), "c) d) e (f (g", "c|)|d|)|e|(f (g"),
    (fn.line_tokenize, "a\n\nb", "a|b"),
    (lambda c: fn.line_tokenize(c, "keep"), "a\n\nb\n", "a||b"),
    (fn.nist_international_tokenize, "Hello 阿里巴巴 world", "Hello|阿里巴巴|world"),
    (fn.nist_tokenize, "It's 3.5, no? <skipped>a&amp;quot;b", "It's|3.5|,|no|?|a\"b"),
    (fn.legality_tokenize, "wonderful", "w|ond|erf|ul"),
    (fn.sonority_tokenize, "justification", "jus|ti|fi|ca|tion"),
    (fn.texttiling_tokenize, "para one\n\npara two\n\npara three", "para one|para two|para three"),
    (fn.wordpunct_tokenize, "naïve café... x_1", "naïve|café|...|x_1"),
    (fn.blankline_tokenize, "a\n \n b \n\n\nc", "a|b|c"),
    (fn.whitespace_tokenize, " x y ", "x|y"),
]


@pytest.mark.parametrize("k", range(len(GOLDEN)))
def test_golden(spark, k):
    function, text, want = GOLDEN[k]
    assert "|".join(values(spark, function, [text])[0]) == want


def test_detokenize(spark):
    cases = [(["a", "--", "b"], "a--b"), (["Hello", ",", "world", "."], "Hello, world."), ([], ""), (["I", "ca", "n't", "do", "it", "."], "I can't do it."), (["He", "said", "``", "hello", "''", "."], 'He said "hello".')]
    assert values(spark, fn.detokenize, [c[0] for c in cases], "array<string>") == [c[1] for c in cases]
    assert values(spark, lambda c: fn.detokenize(c, True), [["-LRB-", "x", "-RRB-"]], "array<string>") == ["(x)"]


def test_spans(spark):
    pairs = lambda rows: [[tuple(s) for s in r] for r in rows]
    assert pairs(values(spark, lambda c: fn.string_span_tokenize(c, " "), ["a b c", "", "  a", "é  b "])) == [[(0, 1), (2, 3), (4, 5)], [], [(2, 3)], [(0, 1), (2, 2), (3, 4)]]
    assert pairs(values(spark, lambda c: fn.regexp_span_tokenize(c, r"\s+"), ["a b  c", "", "  ", "é x "])) == [[(0, 1), (2, 3), (5, 6)], [(0, 0)], [], [(0, 1), (2, 3)]]
    assert pairs(values(spark, lambda c: fn.regexp_span_tokenize(c, r"\d+"), ["hello", "123", "a1b"])) == [[(0, 5)], [(3, 3)], [(0, 1), (2, 3)]]
    relative = values(spark, fn.spans_to_relative, [[(0, 4), (5, 12)], []], "array<struct<start:int,end:int>>")
    assert pairs(relative) == [[(0, 4), (1, 7)], []]
    assert pairs(values(spark, lambda c: fn.align_tokens(F.split(c, r"\|"), F.lit("é a bb")), ["é|a|bb"])) == [[(0, 1), (2, 3), (4, 6)]]
    assert values(spark, lambda c: fn.align_tokens(F.split(c, r"\|"), F.lit("a b"), strict=False), ["b|a"]) == [None]
    with pytest.raises(Exception, match='substring "a" not found in "x b"'):
        values(spark, lambda c: fn.align_tokens(F.array(F.lit("a")), c), ["x b"])
    with pytest.raises(ValueError, match="must not be empty"):
        fn.string_span_tokenize("x", "")
    got = values(spark, fn.word_spans, ['Say "hi" now', "plain words"])
    assert pairs(got) == [[(0, 3), (4, 5), (5, 7), (7, 8), (9, 12)], [(0, 5), (6, 11)]]
    assert values(spark, fn.is_cjk, ["㏾", "﹟", "一", "가", "😀", ""]) == [True, False, True, True, False, False]


def test_errors(spark):
    for call in (lambda: fn.line_tokenize("x", "some"), lambda: fn.word_tokenize("x", mode="other"), lambda: fn.sexpr_tokenize("x", parens="(")):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(Exception, match="Un-matched close paren at char 1"):
        values(spark, fn.sexpr_tokenize, ["a)"])
    assert values(spark, lambda c: fn.sexpr_tokenize(c, on_error="null"), ["a)", "(b)"]) == [None, ["(b)"]]
    with pytest.raises(ValueError, match="Un-matched open paren at char 2"):
        groups("a (b")
    assert values(spark, lambda c: fn.add(c, F.lit(1)), [2**63 - 1, -1, None], "bigint") == [-(2**63), 0, None]


ALL = [
    fn.space_tokenize, fn.tab_tokenize, fn.char_tokenize, fn.line_tokenize, fn.whitespace_tokenize, fn.blankline_tokenize, fn.wordpunct_tokenize, fn.treebank_tokenize, fn.word_tokenize,
    fn.sent_tokenize, fn.casual_tokenize, fn.toktok_tokenize, fn.nist_tokenize, fn.nist_international_tokenize, fn.xml_escape, fn.xml_unescape, fn.legality_tokenize, fn.sonority_tokenize,
    fn.texttiling_tokenize, fn.sexpr_tokenize,
]


def test_edges_and_nulls(spark):
    df = spark.createDataFrame([(x,) for x in [*EDGES, None]], "x string")
    for r in df.select("x", *[f(F.col("x")).alias(str(k)) for k, f in enumerate(ALL)]).collect():
        assert all((v is None) == (r["x"] is None) for v in r[1:])
    assert values(spark, fn.char_tokenize, EDGES) == [list(x) for x in EDGES]
    assert values(spark, fn.space_tokenize, EDGES) == [x.split(" ") for x in EDGES]
    assert values(spark, fn.legality_tokenize, ["", "12"]) == [[""], ["12"]]


ALPHABET = st.text(alphabet="ab .,!?'\"-()\n\tAé😀1:;&<[|", max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ALPHABET, min_size=40, max_size=80))
def test_invariants(spark, texts):
    assert values(spark, lambda c: fn.xml_unescape(fn.xml_escape(c)), texts) == texts
    for text, tokens in zip(texts, values(spark, fn.wordpunct_tokenize, texts), strict=True):
        assert "".join(tokens) == re.sub(r"\s", "", text)
    for text, spans in zip(texts, values(spark, lambda c: fn.string_span_tokenize(c, "ab"), texts), strict=True):
        if text.isascii():
            assert [text[a:b] for a, b in spans] == [p for p in text.split("ab") if p]
    for text, own in zip(texts, values(spark, fn.sent_tokenize, texts), strict=True):
        assert re.sub(r"\s", "", "".join(own)) == re.sub(r"\s", "", text)
    for text, lines in zip(texts, values(spark, lambda c: fn.line_tokenize(c, "keep"), texts), strict=True):
        assert lines == ((text[:-1] if text.endswith("\n") else text).split("\n") if text else [])


def test_sentence_breaks_by_all_tokens():
    """The walk over chunks with end marks finds what a walk over all tokens finds."""
    rng = random.Random(3)
    words = ["Mr.", "the", "U.S.", "He", "5.", "...", "?", "!", '"', "a.", "(b.)", "J.", "end.", "-", "--", "x,y.", "Inc.", "Most", "it.\n", "3.5", "'s", "no?yes", ";", ".)"]
    model = sentences.SentenceModel(contexts={"the": 112, "he": 14, "most": 18, "end": 64})
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 14)))
        if sentences._SPREAD_DOTS.search(text):
            continue
        found = [(m.end(), sentences.Token(m[0], model)) for m in sentences._TOKEN.finditer(text)]
        want = [end for (end, t), after in zip(found, [*found[1:], None]) if (sentences.breaks_before(t, after[1], model) if after else t.breaks)]
        assert sentences.break_ends(text, model) == want


def test_relational_sentences_agree(spark):
    from textloom.plans.sentences import sentence_table

    rng = random.Random(4)
    words = ["Mr.", "the", "U.S.", "He", "5.", "...", "?", "!", "a.", "J.", "end.", "--", "Inc.", "Most", "it.", "3.5", "word", "Sales"]
    model = sentences.SentenceModel(contexts={"the": 112, "he": 14, "most": 18, "end": 64})
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got: dict = {}
    for r in sentence_table(docs, model=model).orderBy("doc_id", "sentence").collect():
        got.setdefault(r["doc_id"], []).append(r["sentence_text"])
    for k, text in rows:
        assert got[k] == [text[a:b] for a, b in sentences.sentence_spans(text, model, realign=False)]


def test_learned_contexts(spark):
    from textloom.plans.sentences import learn_contexts

    docs = spark.createDataFrame([("The cat saw the dog. The dog left. He saw Rome.",), ("They like Rome. the end",)], "text string")
    bits = {r["type"]: r["bits"] for r in learn_contexts(docs, least=1).collect()}
    assert bits["the"] == sentences.BEG_UC | sentences.MID_LC | sentences.BEG_LC and bits["rome."] == sentences.MID_UC and bits["cat"] == sentences.MID_LC


def test_syllables_and_tiles(spark):
    assert onset_syllables("wonderful", {"d", "w", "f"}) == ["won", "der", "ful"]
    words = spark.createDataFrame([("string",), ("Strong",), ("apple",), ("12",), (None,)], "word string")
    assert {(r["onset"], r["n"], r["total"]) for r in fn.legal_onsets(words).collect()} == {("str", 2, 4), ("12", 1, 4)}
    rng = random.Random(1)
    tokens = [rng.choice(["a", "b", "c", "d"]) for _ in range(90)]
    sims = similarities(tokens, 10)
    for k, gap in enumerate(range(10, 80)):
        left, right = tokens[gap - 10 : gap], tokens[gap : gap + 10]
        dot = sum(left.count(t) * right.count(t) for t in set(left))
        norm = lambda x: sum(x.count(t) ** 2 for t in set(x)) ** 0.5
        assert abs(sims[k] - dot / norm(left) / norm(right)) < 1e-6
    topics = " ".join(["cat dog pet"] * 20 + ["sun moon star"] * 20)
    assert len(segments(topics)) >= 2 and " ".join(segments(topics)) == topics


def test_sql_names_streams_and_files(spark, tmp_path):
    from textloom.operators.tokens import gpu_info, is_gpu_available, register, tokens
    from textloom.sources.texts import read_texts, write_tokens
    from textloom.streaming.texts import stream_texts, tokenized, windowed_counts

    assert {"toktok_tokenize", "sent_tokenize", "detokenize"} <= set(register(spark))
    assert spark.sql("SELECT toktok_tokenize('It costs $5.00.') AS t, sent_tokenize('A bee. See dee.') AS s").first() == (["It", "costs", "$", "5.00", "."], ["A bee.", "See dee."])
    docs = spark.createDataFrame([(1, "A bee. See dee."), (2, "x")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = tokenized(stream_texts(spark, str(tmp_path / "in"), docs.schema), fn.sent_tokenize)
    query = stream.writeStream.format("memory").queryName("sentences_out").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r["tokens"]) for r in spark.table("sentences_out").collect()} == {("A bee.", "See dee."), ("x",)}
    timed = docs.withColumn("ts", F.current_timestamp())
    assert windowed_counts(timed, fn.whitespace_tokenize, "ts").count() == 5
    table = tokens(read_texts(spark, str(tmp_path / "in")), fn.whitespace_tokenize, holding="x")
    write_tokens(table, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).collect() == [(2, 0, "x")]
    docs.select("text").write.text(str(tmp_path / "txt"))
    assert sorted(r["text"] for r in read_texts(spark, str(tmp_path / "txt"), "text", whole=False).collect()) == ["A bee. See dee.", "x"]
    assert not is_gpu_available() and "false" in gpu_info()
    assert callable(aliases.toktok_tokenize_batch_gpu) and callable(aliases.texttiling_tokenize_gpu) and callable(aliases.xml_escape_py)


def test_late_rows_of_a_stream_are_left_out(spark, tmp_path):
    from textloom.streaming.texts import stream_texts, windowed_counts

    folder, schema = str(tmp_path / "in"), "ts timestamp, text string"
    batch = lambda *rows: spark.createDataFrame(rows, "ts string, text string").select(F.to_timestamp("ts").alias("ts"), "text").write.mode("append").parquet(folder)
    batch(("2024-01-01 12:00:10", "a b"), ("2024-01-01 12:04:00", "a"))
    counts = windowed_counts(stream_texts(spark, folder, schema), fn.whitespace_tokenize, "ts")
    query = counts.writeStream.format("memory").queryName("counts_out").outputMode("append").start()
    query.processAllAvailable()
    assert spark.table("counts_out").count() == 0  # the window is open
    batch(("2024-01-01 12:03:00", "b"), ("2024-01-01 12:30:00", "c"))  # out of order, but not late
    query.processAllAvailable()
    batch(("2024-01-01 12:02:00", "a"), ("2024-01-01 12:50:00", "d"))  # the first is later than ten minutes
    query.processAllAvailable()
    query.stop()
    got = {(r["window"]["start"].strftime("%H:%M"), r["token"], r["n"]) for r in spark.table("counts_out").collect()}
    assert got == {("12:00", "a", 2), ("12:00", "b", 2), ("12:30", "c", 1)}


def test_spans_of_long_texts_take_one_pass(spark):
    import time

    text = "word, " * 40_000
    df = spark.createDataFrame([(text,)], "t string").cache()
    df.count()
    start = time.perf_counter()
    tokens = fn.regexp_tokenize("t", r"\w+")
    row = df.select(fn.string_span_tokenize("t", " ").alias("a"), fn.regexp_span_tokenize("t", ", ").alias("b"), fn.align_tokens(tokens, "t").alias("c"), fn.spans_to_relative(fn.string_span_tokenize("t", " ")).alias("d")).first()
    assert time.perf_counter() - start < 20
    assert [len(row[k]) for k in "abcd"] == [40_000] * 4
    assert [tuple(x) for x in row["c"][-2:]] == [(6 * k, 6 * k + 4) for k in (39_998, 39_999)] and [tuple(x) for x in row["d"][:2]] == [(0, 5), (1, 5)]


def test_contexts_of_a_configured_model(spark, tmp_path):
    from textloom.functions import sentences

    df = spark.createDataFrame([("It sued Acme Inc. Critics objected.",)], "t string")
    plain = sentences.SentenceModel()
    path = tmp_path / "contexts.tsv"
    path.write_text("critics\t34\n", encoding="utf-8")
    assert df.select(fn.sent_tokenize("t")).first()[0] == ["It sued Acme Inc. Critics objected."]
    spark.conf.set(sentences.CONTEXTS, str(path))
    try:
        assert df.select(fn.sent_tokenize("t")).first()[0] == ["It sued Acme Inc.", "Critics objected."]
        assert df.select(fn.word_tokenize("t")).first()[0] == ["It", "sued", "Acme", "Inc", ".", "Critics", "objected", "."]
    finally:
        spark.conf.unset(sentences.CONTEXTS)
    both = plain.with_contexts({"critics": 2}).with_contexts({"critics": 32})
    assert both.contexts == {"critics": 34} and both.cleared() == plain
    assert df.select(fn.sent_tokenize("t", model=both)).first()[0] == ["It sued Acme Inc.", "Critics objected."]
    with pytest.warns(UserWarning, match="no sentence model"):
        fn.sent_tokenize("t", language="french")
