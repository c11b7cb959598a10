"""The row-local operators on streams, and windowed token counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_texts(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the files that arrive in a folder."""
    reader = spark.readStream.format(kind).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def tokenized(stream: DataFrame, tokenizer: Callable[[Column], Column], text_col: str = "text") -> DataFrame:
    """A stateless projection: any column function of ``textloom.functions``, sentences included."""
    return stream.withColumn("tokens", tokenizer(F.col(text_col)))


def windowed_counts(stream: DataFrame, tokenizer: Callable[[Column], Column], time_col: str, text_col: str = "text", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, token, n): counts in event-time windows; rows later than ``late`` are left out and their state is dropped."""
    rows = stream.withWatermark(time_col, late).select(time_col, F.explode(tokenizer(F.col(text_col))).alias("token"))
    return rows.groupBy(F.window(time_col, window), "token").agg(F.count("*").alias("n"))
