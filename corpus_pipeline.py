"""A corpus pipeline: each stage reads what the one before has kept.

Language identification rejects documents without a language; near-duplicate removal keeps
one document of each group; passages repeated across documents are cut; sources are mixed
to their target weights; the mix is encoded into pieces. Documents that share an
id are told apart by their text where a stage decides row by row.

Every stage takes tables without rows (and returns none), null ids, texts and sources, repeated rows and
any further columns, whatever their names, and returns the columns that it was given, but for the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.shared import free_name, written

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
#: A language that scores lower is none. At sf0.1 all labelled rows score 0.36 or more; foreign and random text mostly does too,
#: and stays: the limit keeps clean documents first.
LEAST_SCORE = 0.3
#: No SQL expresses these stages; tests hold them against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, the network being trained on those of the open fold. Null, empty and letterless texts have none."""
    from textloom.llm.langid import UNKNOWN, fit, identify
    from textloom.llm.spans import keyed

    net = fit(docs, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    rows, key = keyed(docs, "doc_id", "text")
    good = identify(rows, net, id_col=key).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(key)
    return rows.join(good, key, "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id. Texts without words and null ids stay."""
    from textloom.llm.minhash import near_duplicates as find
    from textloom.llm.spans import keyed

    rows, key = keyed(docs, "doc_id", "text")
    kept = find(rows, id_col=key).where("kept").select(key)
    return rows.join(kept, key, "left_semi").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without passages that an earlier one has; none is left without any text that had some."""
    from textloom.llm.spans import without_repeats

    # columns that share a name with what the operator adds would give way: they travel under others
    names = docs.columns
    own = [n if n in DOCUMENT else f"c{k}" for k, n in enumerate(names)]
    cut = without_repeats(docs.toDF(*own))
    left = cut.where("n_removed = 0 or text rlike '\\\\S'")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*own).toDF(*names)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a text without words as often as is certain."""
    from textloom.llm.mixing import mixed
    from textloom.llm.spans import keyed

    rows, key = keyed(docs, "doc_id", "text")
    copies = free_name(rows, "_copies")
    times = mixed(rows, id_col=key).where("times > 0").select(key, F.sequence(F.lit(1), F.col("times").cast("int")).alias(copies))
    return rows.join(times, key).withColumn(copies, F.explode(copies)).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document of the mix, and whether they give its text again."""
    from textloom.llm.pieces import encoded, load
    from textloom.llm.queries import PIECE_MODEL

    return encoded(docs, load(PIECE_MODEL)).select("doc_id", "n_pieces", "pieces", "exact")


STAGES: list[tuple[str, Callable]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
