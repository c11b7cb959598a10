"""Mixing sources to target weights by the cube method of balanced sampling.

Each source has a target number of words. A document is taken ``floor(r)`` times
for certain, r being target over source size, and once more with the probability
that is left. The cube method decides these: in its flight phase it moves the
probabilities along directions that change neither the expected number of
documents nor of words, until at most two of a block are undecided. Blocks of a
source are dealt by hash; what they leave undecided meets in fewer blocks, level
by level, and the last two units of a source are landed with the smallest error
in words. No task sees more than about ``BLOCK`` units, whatever a source's size.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import textkernel as tk
from textloom.llm.shared import bounded_batches, written

WEIGHTS = (5, 2, 1)
BLOCK = 4096
EPSILON = 1e-9


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends the number of words of the last column, a text, in its place."""
    for batch in batches:
        data, offs = tk.buffers(batch.column(batch.num_columns - 1))
        sizes = np.zeros(len(offs) - 1, np.int64)
        for lo, hi in tk.slices(offs):
            first = tk.words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])[2]
            sizes[lo:hi] = np.diff(first)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes)], [*batch.schema.names[:-1], "size"])


def targets(totals: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size).

    Sources rank by code point, null last; their weights repeat. Targets stop at
    ``cap`` times the size and what is above is shared anew by weight. Each round
    of that is one aggregate; only its two sums reach the driver.
    """
    placed = written(totals.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    local, part = F.col("at").bitwiseAND((1 << 33) - 1), F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.withColumn("part", part).join(counts.select("part", before.alias("before")), "part").withColumn("rank", F.col("before") + local)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = written(ranked.select("source", "source_size", "rank", weight.alias("weight")), "ranked")
    whole = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, most = 0.0, cap * F.col("source_size")
    while True:
        full = F.lit(level) * F.col("weight") >= most
        row = ranked.agg(F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("size"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight")).first()
        if not row["weight"]:
            break
        raised = (whole - cap * row["size"]) / row["weight"]
        if raised <= level:
            break
        level = raised
    return ranked.select("source", "source_size", "rank", F.least(F.lit(level) * F.col("weight"), most).cast("double").alias("target"))


def flight(sizes: list[int], chances: list[float], rng: random.Random) -> list[float]:
    """Move ``chances`` to 0 or 1, keeping their sum and their sum weighted by ``sizes``; at most two stay between."""
    chances = list(chances)
    waiting = iter(k for k, p in enumerate(chances) if EPSILON < p < 1 - EPSILON)
    active: list[int] = []
    while True:
        while len(active) < 3 and (k := next(waiting, None)) is not None:
            active.append(k)
        s = [sizes[k] for k in active]
        if len(active) == 3 and not s[0] == s[1] == s[2]:
            u = (float(s[2] - s[1]), float(s[0] - s[2]), float(s[1] - s[0]))
            most = max(map(abs, u))
            u = tuple(x / most for x in u)
        elif len(active) >= 2 and s[0] == s[1]:
            u = (1.0, -1.0, 0.0)[: len(active)]
        else:
            break
        up = min((1 - chances[k]) / x if x > 0 else chances[k] / -x for k, x in zip(active, u, strict=True) if x)
        down = min(chances[k] / x if x > 0 else (1 - chances[k]) / -x for k, x in zip(active, u, strict=True) if x)
        step = up if rng.random() * (up + down) < down else -down
        for k, x in zip(active, u, strict=True):
            p = chances[k] + step * x
            chances[k] = 0.0 if p < EPSILON else 1.0 if p > 1 - EPSILON else p
        active = [k for k in active if 0 < chances[k] < 1]
    return [round(p) if p <= EPSILON or p >= 1 - EPSILON else p for p in chances]


def land(sizes: list[int], chances: list[float]) -> list[float]:
    """Decide what the flight left open, with the smallest error in words, then in documents."""
    still = [k for k, p in enumerate(chances) if 0 < p < 1]
    best = min(range(1 << len(still)), key=lambda m: (abs(sum(sizes[k] * ((m >> j & 1) - chances[k]) for j, k in enumerate(still))), abs(sum((m >> j & 1) - chances[k] for j, k in enumerate(still))), m))
    for j, k in enumerate(still):
        chances[k] = float(best >> j & 1)
    return chances


def _decide(level: int, seed: int):
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("order", "ascending"), ("id", "ascending"), ("size", "ascending")])
        sizes, chances = block["size"].to_pylist(), block["chance"].to_pylist()
        rng = random.Random(f"{seed}/{level}/{block['rank'][0].as_py()}/{block['bucket'][0].as_py()}")
        chances = flight(sizes, chances, rng)
        if block["buckets"][0].as_py() == 1:
            chances = land(sizes, chances)
        return block.select(["rank", "id", "size", "order"]).append_column("chance", pa.array(chances, pa.float64()))

    return run


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    cap: float = 2.0,
    weights: tuple[int, ...] = WEIGHTS,
    block: int = BLOCK,
    seed: int = 1,
) -> DataFrame:
    """One row (id_col, source, size, source_size, target, times, taken) for each row of ``docs``.

    ``size`` is the number of words of the text (null or blank: 0), ``times`` how
    often the mix takes the row and ``taken`` the words of that. Rows equal in id,
    source and size are one unit with a number of copies. Texts without words are
    taken as often as is certain. The result depends on the rows and ``seed`` only,
    not on their order or partitions. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    sized = text.mapInArrow(count_words, "id long, source string, size long")
    units = written(sized.groupBy("id", "source", "size").agg(F.count("*").alias("copies")), "units")
    wanted = targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), share, cap, weights)
    units = units.join(wanted.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.withColumn("times", F.floor(rate)).withColumn("expected", F.col("copies") * (rate - F.floor(rate)))
    units = units.withColumn("sure", F.floor("expected")).withColumn("chance", F.col("expected") - F.col("sure"))
    units = written(units.withColumn("order", F.xxhash64("id", "size", F.lit(seed))), "chances")

    still, decided, level = units.where("chance > 0 and size > 0").select("rank", "id", "size", "order", "chance"), None, 0
    while True:
        held = still.groupBy("rank").agg(F.count("*").alias("n")).select("rank", F.ceil(F.col("n") / block).alias("buckets"))
        dealt = still.join(held, "rank").withColumn("bucket", F.pmod(F.xxhash64("order", F.lit(level)), F.col("buckets")))
        done = written(dealt.groupBy("rank", "bucket").applyInArrow(_decide(level, seed), "rank long, id long, size long, order long, chance double"), "decided")
        over = done.where("chance = 1")
        decided = over if decided is None else decided.unionByName(over)
        still, level = done.where("chance > 0 and chance < 1"), level + 1
        if still.isEmpty():
            break
    more = decided.select("rank", F.col("id").alias("i"), F.col("size").alias("z"), F.lit(1).alias("more"))
    out = units.join(more.withColumnRenamed("rank", "r"), (F.col("rank") == F.col("r")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("size") == F.col("z")), "left")
    out = out.withColumn("sure", F.col("sure") + F.coalesce("more", F.lit(0)))
    once = out.where("copies = 1").withColumn("times", F.col("times") + F.col("sure"))
    many = out.where("copies > 1").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).withColumn("times", F.col("times") + (F.col("copy") <= F.col("sure")).cast("long"))
    columns = [F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken")]
    return once.select(*columns).unionByName(many.select(*columns))
