"""Sentence segmentation as relational operators over a token table, and learning its contexts.

The row-local form in ``textloom.functions.sentences`` is the faster one. This one keeps
the tokens with all their marks: one exchange by document, one window over its
tokens, the model's tables joined by broadcast where they are small. The text itself does
not travel through the sort; it is joined again at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import sentences as s
from textloom.functions.rx import rx_all

#: The token patterns of ``textloom.functions.sentences`` in the dialect of built-in functions.
_MULTI = r"(?:\-{2,}|\.{2,}|(?:\.[^\S\n]){2,}\.)"
_NO_WORD = r"""[)";}\]*:@'(\{\[?!]"""
_START = r"""[^\(\"\\`{\[:;&\#\*@\)}\]\-,]"""
#: A token with the white space before it.
TOKEN = rf"(?U)\s*(?:{_MULTI}|(?={_START})\S+?(?=\s|\z|{_NO_WORD}|{_MULTI}|,(?=\z|\s|{_NO_WORD}|{_MULTI}))|\S)"


def token_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, pos, token, start, end) with code point offsets."""
    rows = docs.select(id_col, F.posexplode(rx_all(F.col(text_col), TOKEN)).alias("pos", "full"))
    by_place = Window.partitionBy(id_col).orderBy("pos")
    placed = rows.withColumn("end", F.sum(F.length("full")).over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    token = F.regexp_replace("full", r"(?U)\A\s+", "")
    return placed.select(id_col, "pos", token.alias("token"), (F.col("end") - F.length(token)).alias("start"), "end")


def _bare(kind: Column) -> Column:
    return F.when((F.length(kind) > 1) & kind.endswith("."), F.expr("substring(type, 1, length(type) - 1)")).otherwise(kind)


def annotated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: s.SentenceModel | None = None) -> DataFrame:
    """The token table with (type, abbreviation, ellipsis, breaks): whether a sentence ends after the token."""
    model = model or s.DEFAULT
    spark = docs.sparkSession
    t = token_table(docs, id_col, text_col)
    token = F.col("token")
    t = t.withColumn("type", F.when(token.rlike(r"(?U)\A-?[\.,]?\d[\d,\.-]*\.?\z"), F.lit(s.NUMBER)).otherwise(F.lower("token")))
    stem = F.lower(F.expr("substring(token, 1, length(token) - 1)"))
    known = sorted(model.abbreviations)
    abbreviation = token.endswith(".") & (stem.isin(known) | F.element_at(F.split(stem, "-"), -1).isin(known)) & ~token.rlike(r"\.\.\z") & (token != ".")
    t = t.withColumn("ellipsis", token.rlike(r"\.\.\z")).withColumn("abbreviation", abbreviation)
    t = t.withColumn("first", token.isin(".", "?", "!") | (token.endswith(".") & ~F.col("ellipsis") & ~F.col("abbreviation")))
    t = t.withColumn("bare", _bare(F.col("type"))).withColumn("own", F.when(F.col("first"), F.col("bare")).otherwise(F.col("type")))
    contexts = spark.createDataFrame(list(model.contexts.items()), "own string, seen int")
    t = t.join(contexts, "own", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    upper, lower = token.rlike(r"(?U)\A\p{Lu}"), token.rlike(r"(?U)\A\p{Ll}")
    has = lambda bits: F.col("seen").bitwiseAND(bits) != 0
    verdict = F.when(token.isin(*s.MARKS), False).when(upper & has(s.LC) & ~has(s.MID_UC), True).when(lower & (has(s.UC) | ~has(s.BEG_LC)), False)
    t = t.withColumn("verdict", verdict).withColumn("upper", upper)
    by_place = Window.partitionBy(id_col).orderBy("pos")
    after = lambda c: F.lead(c).over(by_place)
    pairs = F.concat_ws("\x01", "bare", after("own")).isin([f"{a}\x01{b}" for a, b in sorted(model.collocations)])
    initial = token.rlike(r"(?U)\A[^\W\d]\.\z")
    starter = after("upper") & after("own").isin(sorted(model.starters))
    undo = (initial | (F.col("bare") == s.NUMBER)) & (F.coalesce(~after("verdict"), F.lit(False)) | (after("verdict").isNull() & initial & after("upper") & (after("seen").bitwiseAND(s.LC) == 0)))
    breaks = (
        F.when(~token.endswith(".") | after("own").isNull(), F.col("first"))
        .when(pairs, False)
        .when((F.col("abbreviation") | F.col("ellipsis")) & ~initial & (F.coalesce(after("verdict"), F.lit(False)) | starter), True)
        .when(undo, False)
        .otherwise(F.col("first"))
    )
    return t.withColumn("breaks", breaks).select(id_col, "pos", "token", "start", "end", "type", "abbreviation", "ellipsis", "breaks")


def sentence_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: s.SentenceModel | None = None) -> DataFrame:
    """(id_col, sentence, start, end, text) without moving closing marks back."""
    t = annotated(docs, id_col, text_col, model)
    before = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("sentence", F.coalesce(F.sum(F.col("breaks").cast("int")).over(before), F.lit(0)))
    spans = t.groupBy(id_col, "sentence").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    text = F.substring(F.col(text_col), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    return spans.join(docs.select(id_col, text_col), id_col).select(id_col, "sentence", "start", "end", text.alias("sentence_text"))


def learn_contexts(docs: DataFrame, text_col: str = "text", least: int = 2) -> DataFrame:
    """(type, bits) learnt from a corpus: in which case types were seen at sentence beginnings, inside, or unclear.

    Types seen fewer than ``least`` times are left out. One grouping with partial bit-ors.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("text"))
    t = annotated(rows, "_row", "text")
    by_place = Window.partitionBy("_row").orderBy("pos")
    ended, unclear = F.lag("breaks").over(by_place), F.coalesce(F.lag("abbreviation").over(by_place) | F.lag("ellipsis").over(by_place), F.lit(False))
    place = F.when(F.col("pos") == 0, 0).when(unclear, 2).when(ended, 0).otherwise(1)
    upper, lower = F.col("token").rlike(r"(?U)\A\p{Lu}"), F.col("token").rlike(r"(?U)\A\p{Ll}")
    bits = F.when(upper, F.shiftleft(F.lit(s.BEG_UC), 0) * F.pow(F.lit(2), place)).when(lower, F.lit(s.BEG_LC) * F.pow(F.lit(2), place)).cast("int")
    seen = t.select("type", bits.alias("bits")).where("bits is not null")
    return seen.groupBy("type").agg(F.bit_or("bits").alias("bits"), F.count("*").alias("n")).where(F.col("n") >= least).select("type", "bits")
