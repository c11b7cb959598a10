"""Corpus-wide use of the column functions: token tables, counts, registration under SQL names."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import functions as fn
from textloom.functions.rx import STRINGS, arrow


def tokens(docs: DataFrame, tokenizer: Callable[[Column], Column], text_col: str = "text", id_cols: Sequence[str] = ("doc_id",), holding: str | None = None) -> DataFrame:
    """(id_cols, pos, token). ``holding`` keeps texts with that string only, before any of them is cut: a filter
    on the token afterwards cannot be moved there by the planner, for tokenizers that rewrite nothing it loses nothing."""
    rows = docs.where(F.contains(F.col(text_col), F.lit(holding))) if holding else docs
    return rows.select(*id_cols, F.posexplode(tokenizer(F.col(text_col))).alias("pos", "token"))


def token_counts(docs: DataFrame, tokenizer: Callable[[Column], Column], text_col: str = "text") -> DataFrame:
    """(token, n) over all texts; counted before the shuffle."""
    return docs.select(F.explode(tokenizer(F.col(text_col))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def batch(docs: DataFrame, tokenizer: Callable[[Column], Column], text_col: str = "text", out_col: str = "tokens") -> DataFrame:
    """``docs`` with the tokens of each row."""
    return docs.withColumn(out_col, tokenizer(F.col(text_col)))


def is_gpu_available() -> bool:
    return False


def gpu_info() -> str:
    return json.dumps({"available": False, "reason": "operators run on Spark executors"})


def gpu_warmup() -> None:
    return None


#: SQL name, argument names, and the column function on them.
_SQL: dict[str, tuple[str, Callable[..., Column]]] = {
    "word_tokenize_line": ("text STRING", fn.treebank_tokenize),
    "space_tokenize": ("text STRING", fn.space_tokenize),
    "tab_tokenize": ("text STRING", fn.tab_tokenize),
    "char_tokenize": ("text STRING", fn.char_tokenize),
    "line_tokenize": ("text STRING", fn.line_tokenize),
    "blankline_tokenize": ("text STRING", fn.blankline_tokenize),
    "whitespace_tokenize": ("text STRING", fn.whitespace_tokenize),
    "wordpunct_tokenize": ("text STRING", fn.wordpunct_tokenize),
    "toktok_tokenize": ("text STRING", fn.toktok_tokenize),
    "nist_tokenize": ("text STRING", fn.nist_tokenize),
    "nist_international_tokenize": ("text STRING", fn.nist_international_tokenize),
    "xml_escape": ("text STRING", fn.xml_escape),
    "xml_unescape": ("text STRING", fn.xml_unescape),
    "is_cjk": ("ch STRING", fn.is_cjk),
    "legality_tokenize": ("word STRING", fn.legality_tokenize),
    "detokenize": ("tokens ARRAY<STRING>", fn.detokenize),
}


def _sql_of(spark: SparkSession, argument: str, function: Callable[..., Column]) -> str:
    """SQL text of a column function's expression."""
    name = argument.split()[0]
    plan = spark.createDataFrame([], argument.lower()).select(function(F.col(name)).alias("out"))._jdf.queryExecution().analyzed()
    return _lambdas(plan.expressions().head().child().sql())


def _lambdas(sql: str) -> str:
    """Printed lambdas of one variable, ``lambdafunction(body, namedlambdavariable())``, as SQL reads them."""
    mark, tail = "lambdafunction(", ", namedlambdavariable())"
    while (at := sql.rfind(mark)) >= 0:  # the last one holds no other
        end = sql.index(tail, at)
        body = sql[at + len(mark) : end].replace("namedlambdavariable()", "x")
        sql = f"{sql[:at]}(x -> {body}){sql[end + len(tail) :]}"
    return sql


def register(spark: SparkSession) -> list[str]:
    """Make the row-local functions SQL-callable: ``SELECT toktok_tokenize(text) FROM t``. Returns their names.

    Those made of built-in functions become SQL functions that the planner inlines;
    sentences, groups and tiles are Arrow functions.
    """
    from textloom.functions.sentences import DEFAULT, sentence_spans
    from textloom.functions.sexpr import groups
    from textloom.functions.tiling import segments

    names = []
    for name, (argument, function) in _SQL.items():
        names.append(name)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({argument}) RETURN {_sql_of(spark, argument, function)}")
    row_by_row = {"sent_tokenize": lambda t: [t[a:b] for a, b in sentence_spans(t, DEFAULT)], "sexpr_tokenize": groups, "texttiling_tokenize": segments}
    for name, one in row_by_row.items():
        spark.udf.register(name, arrow(STRINGS, one))
        names.append(name)
    return names
