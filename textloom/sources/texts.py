"""Reading and writing columns of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string"


def read_texts(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, whole: bool = True) -> DataFrame:
    """Rows with a text column from Parquet, ORC, JSON or CSV, or from text files: a row for each file (``whole``) or line.

    JSON and CSV are read with a schema, so nothing is scanned to infer one.
    """
    if kind == "text":
        rows = spark.read.option("wholetext", whole).text(path)
        return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    reader = spark.read.schema(schema or SCHEMA) if kind in ("json", "csv") else spark.read
    if kind == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.format(kind).load(path)


def write_tokens(tokens: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """A token table as files; arrays stay arrays."""
    tokens.write.mode(mode).format(kind).save(path)
