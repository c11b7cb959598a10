import duckdb
import pandas as pd
from pyspark.sql import functions as F

from textloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, pair_id string, a string"
ROWS = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "one <|end|>"), (0, 2, "user", "more"), (0, 3, "assistant", "é😀"),
    (1, 0, "user", "hi"), (1, 1, "assistant", "one <|end|>"), (1, 2, "user", "else"),
    (2, 0, "user", "same"), (2, 1, "assistant", None), (3, 0, "user", "same"), (3, 1, "assistant", None),
    (4, 0, None, "alone"), (7, 0, "user", "no chosen"), (None, 0, "user", "lost"),
    (8, 1, "user", "tie b"), (8, 1, "user", "tie a"), (8, 1, "user", "tie a"), (8, None, "system", ""), (9, 0, "user", "x" * 200_000), (9, 1, "assistant", "short"),
    (10, 0, "a|>\n<|assistant", "x<"), (11, 0, "<", "y"),
]


def test_against_sql(spark):
    conversations = pd.DataFrame(ROWS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    want = sorted(map(str, duckdb.sql(f"SELECT * FROM ({chat.ORACLE})").fetchall()))
    df = spark.createDataFrame([(*r, "clash", "clash") for r in ROWS], SCHEMA).repartition(5)
    got = chat.preferences(df, F.expr("conv_id div 2"), F.col("conv_id") % 2 == 0)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    row = {r["pair_id"]: r for r in got.collect()}
    assert row[0]["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\none < |end|><|end|>\n" and row[0]["n_prefix"] == 2
    assert row[0]["chosen"] == "<|user|>\nmore<|end|>\n<|assistant|>\né😀<|end|>\n" and row[0]["chosen_mask"] == "0:21 0:14 1:10"
    assert row[5]["chosen"] == "<|a_____assistant|>\nx<<|end|>\n" and row[5]["rejected"] == "<|_|>\ny<|end|>\n"
    assert row[1]["chosen"] == row[1]["rejected"] == "" and row[2]["rejected"] is None and row[3]["chosen"] is None


def test_empty_and_plan(spark):
    df = chat.preferences(spark.createDataFrame([], SCHEMA), F.expr("conv_id div 2"), F.col("conv_id") % 2 == 0)
    assert df.count() == 0
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
