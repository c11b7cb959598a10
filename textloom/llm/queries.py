"""The registered queries of this subpackage, one thin function for each operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: A public model; only its path is used here.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int) -> Column:
    """crc32 of the id's digits (none of a null id), modulo n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.langid import fit, identify

    docs = _table(spark, sf_dir, "documents")
    return identify(docs, fit(docs, _fold(4) != 2)).select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op2_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.spans import without_repeats

    return without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.fingerprint import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.pieces import encoded, load

    return encoded(_table(spark, sf_dir, "documents"), load(PIECE_MODEL), digest=True)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.toxicity import fit, toxicity

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs, _table(spark, sf_dir, "labels"), _fold(4) != 2)
    return toxicity(docs, model).select("doc_id", (_fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "best", "evidence", "segments")


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.kneser_ney import fit, scored

    docs = _table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs.where(_fold(7) != 2)))
    return out.select("doc_id", (_fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), ngram=4)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.mixing import mixed

    return mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.neighbours import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 are the chosen and the rejected one of pair k."""
    from textloom.llm.chat import preferences

    return preferences(_table(spark, sf_dir, "conversations"), F.expr("conv_id div 2"), F.col("conv_id") % 2 == 0)


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from textloom.llm import chat, minhash

    return {"op7_minhash": minhash.ORACLE, "op10_preferences": chat.ORACLE}
