"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder. Only where a local session leaves it
unset is a folder of this machine used. Tables are plain Parquet, so a lost
executor costs nothing but the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from textloom.deploy import ship


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Keep the batches of rows that go to Python workers to about ``size`` bytes, and so both sides' buffers.

    The package is sent along, if need be. Long texts would otherwise fill batches of any number of bytes. A lower limit of the session stays.
    """
    ship()
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").lower()
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    number = int("".join(c for c in now if c.isdigit()) or 0)
    unit = next((units[c] for c in now if c in "kmg"), 1)
    if not 0 < number * unit <= size:
        spark.conf.set(key, str(size))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/textloom-{uuid.uuid4().hex}/{name}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage is cut."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, lengthened until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def packed(df: DataFrame) -> DataFrame:
    """The rows in at most four tasks for each core of the cluster, without a shuffle: for tables of
    links, which are small beside the texts, so that many partitions of few rows cost no tasks of their own."""
    return df.coalesce(4 * max(2, df.sparkSession.sparkContext.defaultParallelism))

