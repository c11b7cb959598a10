import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm.neighbours import chi_square_quantile, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, score string"


def brute(rows, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % 20 == 0:
            scores = sorted((-float(np.dot(q, x)), j) for j, x in good if j != i)
            out[i] = [(j, -s) for s, j in scores[:k]]
    return out


def rows_of(rng):
    base = rng.standard_normal((2600, 16))
    base[:900] = base[0] + 0.05 * base[:900]
    base[:, 0] *= 3
    rows = [(k, [float(x) for x in np.float32(v)]) for k, v in enumerate(base)]
    rows += [(3000 + k, rows[1700][1]) for k in range(300)]
    rows += [(4000, None), (4020, [0.0] * 16), (4040, [float("nan")] * 16), (4060, [None] + [1.0] * 15), (4080, [float("inf")] * 16), (None, rows[5][1]), (20, rows[20][1])]
    return rows


@pytest.mark.parametrize("cell", [128, 100_000])
def test_recall_and_ranks(spark, cell):
    rows = rows_of(np.random.default_rng(3))
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA).repartition(5)
    got: dict = {}
    for q, rank, j, s, _ in nearest(df, F.col("vec_id") % 20 == 0, cell=cell, queries_per_task=16).orderBy("query_id", "rank").collect():
        got.setdefault(q, []).append((j, s))
        assert rank == len(got[q])
    want = brute(dict.fromkeys([(i, tuple(v) if v else None) for i, v in rows]), 20)
    assert got.keys() == want.keys()
    hits = 0
    for q, own in want.items():
        assert len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        floor = own[-1][1] - 1e-9
        hits += sum(s >= floor for _, s in got[q])
    assert hits >= 0.9 * 20 * len(want)
    assert [j for j, _ in got[3000]] == [j for j, _ in want[3000]]


def test_small_and_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert nearest(none, F.col("vec_id") % 20 == 0).count() == 0
    df = spark.createDataFrame([(0, [1.0, 0.0], 0, 0, ""), (1, [0.5, 0.5], 0, 0, ""), (2, [2.0, 1.0], 0, 0, "")], SCHEMA)
    assert [tuple(r) for r in nearest(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(0, 1, 2, 2.0, 3), (0, 2, 1, 0.5, 3)]


def test_quantile():
    assert chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


def measured(spark, df, cell=4096):
    """(recall, share of the points that a query verified) against brute force in doubles."""
    rows = df.select("vec_id", "embedding").toArrow()
    x, ids = np.array(rows["embedding"].to_pylist(), np.float64), rows["vec_id"].to_numpy()
    got: dict = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, cell=cell).collect():
        got.setdefault(r["query_id"], []).append(r)
    hits, shares = 0, []
    for q, own in got.items():
        scores = x @ x[ids == q][0]
        floor = np.sort(scores[ids != q])[-20]
        hits += sum(r["score"] >= floor - 1e-12 for r in own)
        shares.append(own[0]["verified"] / len(x))
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 20 == 0)
    return hits / (20 * len(got)), float(np.mean(shares))


def test_recall_and_share_verified_on_the_tables(spark):
    recall, share = measured(spark, spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    print("sf0.1", recall, share)
    assert recall >= 0.9 and share < 0.6


def test_stop_holds_where_there_is_structure(spark):
    """Vectors near a surface of few dimensions: few points are verified, in cells and blocks of any size."""
    rng = np.random.default_rng(4)
    x = np.tanh(rng.standard_normal((6000, 4)) @ rng.standard_normal((4, 64))) + 0.02 * rng.standard_normal((6000, 64))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    df = spark.createDataFrame([(k, v.tolist(), 1, 2, "x") for k, v in enumerate(x)], SCHEMA)
    recall, share = measured(spark, df, cell=512)
    print("surface", recall, share)
    assert recall >= 0.9 and share < 0.1
