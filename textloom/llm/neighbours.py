"""Nearest neighbours by inner product: low-dimensional stable projections and kd-trees.

Vectors get one more component so that all have the same length; then a larger inner
product is a smaller distance. Gaussian (2-stable) projections to half the dimensions, ``M`` at
most, turn a distance d into d times a chi variable. The points of a cell are visited in the order of their projected
distance r, in steps, and verified on the original vectors, until the chi-square test holds: a
point that is nearer than the k-th best distance found would be as far out as r with
probability ``1 - TAU`` at most. Points beyond that are never verified.

A kd-tree over the projections of at most ``SAMPLE`` rows cuts the space into cells; every
row is indexed in its cell. A query first searches its own cell, which bounds its
k-th distance, then those other cells that the stopping test does not rule out. Equal vectors are one point with a list of the
smallest ``k + 1`` ids, enough for any answer. Queries that visit a cell are dealt in
blocks and so are the points of a large cell, so neither a popular cell nor a repeated vector makes a task unbounded,
however many rows there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.shared import bounded_batches, written

M, TAU, SAMPLE, CELL, STEP, QUERIES = 32, 0.9, 20_000, 4096, 64, 512


def chi_square_quantile(p: float, k: int) -> float:
    """Of ``k`` (even) degrees of freedom, by bisection on the closed form."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        term, total = 1.0, 1.0
        for j in range(1, k // 2):
            term *= x / 2 / j
            total += term
        low, high = (x, high) if 1 - np.exp(-x / 2) * total < p else (low, x)
    return low


@dataclass
class Boxes:
    """Leaves of a kd-tree: ``cuts[level][node]`` is (dimension, value); ``low`` and ``high`` bound each leaf."""

    cuts: list
    low: np.ndarray
    high: np.ndarray

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for dims, values in self.cuts:
            node = 2 * node + (points[np.arange(len(points)), dims[node]] > values[node])
        return node

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each leaf's box."""
        out = np.zeros((len(points), len(self.low)))
        for d in range(points.shape[1]):
            x = points[:, d : d + 1]
            gap = np.maximum(np.maximum(self.low[:, d] - x, x - self.high[:, d]), 0)
            out += gap * gap
        return out


def kd_tree(points: np.ndarray, depth: int) -> Boxes:
    """Median cuts along each node's widest dimension; outer boxes are unbounded."""
    m = points.shape[1]
    low, high = np.full((1, m), -np.inf), np.full((1, m), np.inf)
    groups, cuts = [points], []
    for _ in range(depth):
        dims = np.array([int(np.argmax(np.ptp(g, axis=0))) if len(g) else 0 for g in groups])
        values = np.array([float(np.median(g[:, d])) if len(g) else 0.0 for g, d in zip(groups, dims, strict=True)])
        cuts.append((dims, values))
        low, high = np.repeat(low, 2, axis=0), np.repeat(high, 2, axis=0)
        at = np.arange(len(dims))
        high[2 * at, dims], low[2 * at + 1, dims] = values, values
        groups = [part for g, d, v in zip(groups, dims, values, strict=True) for part in (g[g[:, d] <= v], g[g[:, d] > v])]
    return Boxes(cuts, low, high)


@dataclass
class Space:
    """The projection: ``longest`` is the common length that the added component fills up to."""

    dims: int
    longest: float
    matrix: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))
        return np.concatenate([x, rest[:, None]], 1) @ self.matrix

    def project_queries(self, q: np.ndarray) -> np.ndarray:
        return (q * (self.longest / np.sqrt((q * q).sum(1, keepdims=True)))) @ self.matrix[:-1]

    def squared(self, score: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """The squared distance that stands for an inner product."""
        return np.maximum(2 * self.longest**2 - 2 * self.longest * score / norms, 0)


def search(space: Space, queries: np.ndarray, bound: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, places) [queries, k] of the best points verified, by score, then id, and how many each query verified.

    ``bound`` has a score for each query that the k-th best already reaches; places are -1 where there are fewer.
    """
    n = len(points)
    order = np.argsort(ids, kind="stable")
    points, own = points[order], space.project(points[order])
    ask = space.project_queries(queries)
    far = (ask * ask).sum(1)[:, None] + (own * own).sum(1)[None] - 2 * ask @ own.T
    norms = np.sqrt((queries * queries).sum(1))
    best, where = np.full((len(queries), k), -np.inf), np.full((len(queries), k), n)
    seen, active, size = np.zeros(far.shape, bool), np.arange(len(queries)), STEP

    def edge(who: np.ndarray) -> np.ndarray:
        """How far out a query's points may project."""
        kth = np.maximum(best[who, -1], bound[who])
        return np.where(np.isfinite(kth), limit * space.squared(kth, norms[who]), np.inf)[:, None]

    while len(active):
        size = min(n, size)
        near = np.argpartition(far[active], size - 1, axis=1)[:, :size]
        r = np.take_along_axis(far[active], near, 1)
        row, slot = np.nonzero((r <= edge(active)) & ~seen[active[:, None], near])
        at = near[row, slot]
        seen[active[row], at] = True
        score = np.empty(len(row))
        for lo in range(0, len(row), 1 << 14):
            part = slice(lo, lo + (1 << 14))
            score[part] = np.einsum("pd,pd->p", queries[active[row[part]]], points[at[part]])
        owner = np.concatenate([np.repeat(np.arange(len(active)), k), row])
        scores, places = np.concatenate([best[active].ravel(), score]), np.concatenate([where[active].ravel(), at])
        turn = np.lexsort((places, -scores, owner))
        top = turn[np.arange(len(turn)) - np.searchsorted(owner[turn], owner[turn]) < k]
        best[active], where[active] = scores[top].reshape(-1, k), places[top].reshape(-1, k)
        if size == n:
            break
        active = active[r.max(1) <= edge(active)[:, 0]]
        size *= 4
    return best, np.where(np.isfinite(best), order[np.minimum(where, n - 1)], -1), seen.sum(1)


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


FOUND = "query_id long, query_key long, candidate_ids array<long>, score double, verified long"


def _visit(space: Space, k: int, limit: float):
    def run(queries: pa.Table, points: pa.Table) -> pa.Table:
        kinds = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("candidate_ids", pa.list_(pa.int64())), ("score", pa.float64()), ("verified", pa.int64())])
        if not queries.num_rows or not points.num_rows:
            return kinds.empty_table()
        q, x = _matrix(queries["vector"], space.dims), _matrix(points["vector"], space.dims)
        bound = queries["bound"].combine_chunks().fill_null(-np.inf).to_numpy(zero_copy_only=False)
        scores, places, verified = search(space, q, bound, x, points["least"].to_numpy(), k + 1, limit)
        row, slot = np.nonzero(places >= 0)
        found = pa.table([queries["query_id"].take(pa.array(row)), queries["query_key"].take(pa.array(row)), points["ids"].take(pa.array(places[row, slot])), pa.array(scores[row, slot]), pa.nulls(len(row), pa.int64())], kinds)
        work = pa.table([queries["query_id"], queries["query_key"], pa.nulls(len(q), pa.list_(pa.int64())), pa.nulls(len(q), pa.float64()), pa.array(verified)], kinds)
        return pa.concat_tables([found, work])

    return run


def _finite(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tau: float = TAU, sample: int = SAMPLE, cell: int = CELL, queries_per_task: int = QUERIES, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score, verified): the ``k`` rows of largest inner product found for each query.

    ``verified`` is the number of points whose vectors the query was compared with in all. Queries are the rows where ``is_query`` holds, candidates all rows but those of the
    query's own id; with fewer than ``k`` all of them come. Ranks start at 1; ties go to the
    smaller id. Rows without id or vector, vectors that are zero, hold nulls or
    non-finite numbers, or have another length than most (the shortest of equally many), take no part: they have no inner product with the others. Rows equal in
    id and vector count once. No rows give none.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, 16 << 20)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("id is not null").where(_finite(F.col("vector")))
    rows = written(rows.groupBy("id", "vector").agg(F.max("asks").alias("asks")), "vectors")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    shapes = rows.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n"), F.max(norm).alias("longest")).orderBy(F.desc("n"), "dims").first()
    if shapes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
    dims, rng = shapes["dims"], np.random.default_rng(seed)
    low = max(2, min(M, dims // 4 * 2))
    space = Space(dims, float(shapes["longest"]) or 1.0, rng.standard_normal((dims + 1, low)))
    limit = chi_square_quantile(tau, low)
    rows = rows.where(F.size("vector") == dims)
    drawn = _matrix(rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()["vector"], dims)
    depth = max(0, min(int(np.ceil(np.log2(max(1, shapes["n"] / cell)))), int(np.log2(max(1, len(drawn) / 16)))))
    cells = kd_tree(space.project(drawn), depth)

    def array_of(values: np.ndarray) -> pa.Array:
        return pa.array(values.astype(np.int32))

    @F.arrow_udf("int")
    def cell_of(vector: pa.Array) -> pa.Array:
        return array_of(cells.of(space.project(_matrix(pa.chunked_array([vector]), dims))))

    @F.arrow_udf("array<int>")
    def more_cells(vector: pa.Array, bound: pa.Array) -> pa.Array:
        q, kth = _matrix(pa.chunked_array([vector]), dims), bound.fill_null(-np.inf).to_numpy(zero_copy_only=False)
        far = cells.distances(space.project_queries(q))
        edge = np.where(np.isfinite(kth), limit * space.squared(kth, np.sqrt((q * q).sum(1))), np.inf)
        row, at = np.nonzero(far <= edge[:, None])
        return pa.ListArray.from_arrays(array_of(np.searchsorted(row, np.arange(len(q) + 1))), array_of(at))

    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("rank") <= k + 1)
    points = ranked.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("least", F.col("ids")[0])
    points = written(points.withColumn("cell", cell_of("vector")), "points")
    asking = rows.where("asks").select(F.col("id").alias("query_id"), F.xxhash64("vector").alias("query_key"), "vector")
    asking = written(asking.withColumn("home", cell_of("vector")), "queries")
    parts = written(points.groupBy("cell").agg(F.ceil(F.count("*") / (2 * cell)).cast("int").alias("parts")), "parts")
    salt = F.pmod(F.xxhash64("query_id", "query_key"), F.col("blocks")).cast("int").alias("block")

    def visited(visits: DataFrame) -> DataFrame:
        """Top points of each (query, cell) visit, dealt in blocks of the cell's points and of the queries that visit it."""
        counts = visits.groupBy("cell").agg(F.ceil(F.count("*") / queries_per_task).cast("int").alias("blocks")).join(parts, "cell")
        dealt = visits.join(counts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), salt, "query_id", "query_key", "vector", "bound")
        spread = points.join(counts, "cell").withColumn("part", F.pmod(F.xxhash64("least"), "parts").cast("int"))
        spread = spread.select("cell", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vector", "ids", "least")
        return dealt.groupBy("cell", "part", "block").cogroup(spread.groupBy("cell", "part", "block")).applyInArrow(_visit(space, k, limit), FOUND)

    def expanded(found: DataFrame) -> DataFrame:
        """(query, candidate, score) once each, and a row without candidate for the points verified."""
        own = found.select("query_id", "query_key", "score", "verified", F.explode_outer("candidate_ids").alias("vec_id")).where("vec_id is null or vec_id <> query_id")
        return own.groupBy("query_id", "query_key", "vec_id").agg(F.max("score").alias("score"), F.sum("verified").alias("verified"))

    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc_nulls_last("score"), "vec_id")
    first = written(visited(asking.select(F.col("home").alias("cell"), "query_id", "query_key", "vector", F.lit(None).cast("double").alias("bound"))), "first")
    kth = expanded(first).withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).where("vec_id is not null").select("query_id", "query_key", F.col("score").alias("bound"))
    bounded = asking.join(kth, ["query_id", "query_key"], "left").withColumn("cells", more_cells("vector", "bound"))
    onward = bounded.select(F.explode("cells").alias("cell"), "home", "query_id", "query_key", "vector", "bound").where("cell <> home").drop("home")
    second = visited(written(onward, "visits"))
    answer = expanded(first.unionByName(second)).withColumn("rank", F.row_number().over(best)).withColumn("verified", F.sum("verified").over(Window.partitionBy("query_id", "query_key")))
    return answer.where((F.col("rank") <= k) & F.col("vec_id").isNotNull()).select("query_id", "rank", "vec_id", "score", "verified")
