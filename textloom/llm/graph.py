"""Connected components of an edge table, by alternating large-star and small-star passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import packed, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours are hung on its smallest one: the larger neighbours, or the smaller and itself."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = packed(near.join(least, "u"))
    if large:
        hung = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return packed(hung.where("u <> v").distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether every edge hangs a leaf on a centre: no upper end twice, and none that is a lower end."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of the edges (u, v): component is the smallest id reachable.

    Null ends and loops are ignored; no edges give no rows. Each pass is written
    to the shared folder, and only whether another is needed reaches the driver.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().transform(packed), "edges")
    while not _settled(now):
        now = written(_stars(_stars(now, True), False), "edges")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
