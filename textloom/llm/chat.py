"""Preference formatting of conversations, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_END, TRAINED = "<|end|>\n", "assistant"


def _escaped(text: Column) -> Column:
    """Texts must not hold marks of the template."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _name(role: Column) -> Column:
    """A role must not hold any sign of the mark that it stands in, or it could forge another."""
    return F.translate(F.coalesce(role, F.lit("")), "<|>\r\n", "_____")


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["head"], t["body"])), "")


def _mask(turns: Column) -> Column:
    """``flag:length`` runs over the code points of the completion; flag 1 is trained on."""
    trained = lambda t: F.concat(F.lit("0:"), F.length(t["head"]), F.lit(" 1:"), F.length(t["body"]))
    other = lambda t: F.concat(F.lit("0:"), F.length(t["head"]) + F.length(t["body"]))
    return F.array_join(F.transform(turns, lambda t: F.when(t["role"] == TRAINED, trained(t)).otherwise(other(t))), " ")


def preferences(turns: DataFrame, pair: Column, chosen: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each value of ``pair``: the prompt that its two conversations share and their completions.

    ``turns`` has a row for each turn; ``chosen`` (boolean) says of which of the two
    conversations. Turns are ordered by (turn, role, text), nulls first, so ties and
    repeated rows have one order. The longest common prefix of turns equal in role
    and text (null equals null) becomes ``prompt``, rendered once; the rest of each
    conversation becomes a completion, with a mask that marks the assistant's
    words and end marks. Null roles and texts render as empty; ``<|`` in texts, and the signs ``< | >`` and line ends
    in roles, are rewritten, so no turn can forge a mark. A missing
    side has null completion and mask and shares nothing. Rows without pair or side
    belong to no conversation and are left out. No rows give none.

    A conversation is one cell of the result, so its turns meet in one task; pairs
    are dealt by hash in a single exchange.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = turns.select(pair.alias("pair_id"), chosen.alias("is_chosen"), turn.alias("t")).where("pair_id is not null and is_chosen is not null")
    side = lambda own: F.array_sort(F.collect_list(F.when(own, F.col("t"))))
    both = rows.groupBy("pair_id").agg(side(F.col("is_chosen")).alias("a"), side(~F.col("is_chosen")).alias("b"))
    differs = lambda x, i: ~((i < F.size("b")) & x["role"].eqNullSafe(F.get("b", i)["role"]) & x["text"].eqNullSafe(F.get("b", i)["text"]))
    first = F.array_min(F.transform("a", lambda x, i: F.when(differs(x, i), i)))
    drawn = lambda c: F.transform(c, lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit("<|"), _name(t["role"]), F.lit("|>\n")).alias("head"), F.concat(_escaped(t["text"]), F.lit(TURN_END)).alias("body")))
    both = both.withColumn("n_prefix", F.coalesce(first, F.size("a")))
    both = both.select("pair_id", "n_prefix", F.size("a").alias("chosen_turns"), F.size("b").alias("rejected_turns"), drawn("a").alias("a"), drawn("b").alias("b"))
    rest = lambda c: F.slice(c, F.col("n_prefix") + 1, F.greatest(F.size(c) - F.col("n_prefix"), F.lit(0)))
    given = lambda c, x: F.when(F.size(c) > 0, x)
    return both.select(
        "pair_id",
        "n_prefix",
        "chosen_turns",
        "rejected_turns",
        _joined(F.slice("a", 1, F.col("n_prefix"))).alias("prompt"),
        given("a", _joined(rest("a"))).alias("chosen"),
        given("b", _joined(rest("b"))).alias("rejected"),
        given("a", _mask(rest("a"))).alias("chosen_mask"),
        given("b", _mask(rest("b"))).alias("rejected_mask"),
    )


#: The same rows for pairs of conversations 2k (chosen) and 2k + 1 (rejected).
ORACLE = """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS is_chosen, {'turn': turn, 'role': role, 'text': text} AS t FROM conversations WHERE conv_id IS NOT NULL),
g AS (
  SELECT pair_id,
    coalesce(list(t ORDER BY t.turn NULLS FIRST, t.role NULLS FIRST, t.text NULLS FIRST) FILTER (is_chosen), []) AS a,
    coalesce(list(t ORDER BY t.turn NULLS FIRST, t.role NULLS FIRST, t.text NULLS FIRST) FILTER (NOT is_chosen), []) AS b
  FROM t GROUP BY pair_id),
p AS (
  SELECT *, coalesce(list_min(list_filter(list_transform(range(1, len(a) + 1), lambda i:
      CASE WHEN i <= len(b) AND a[i].role IS NOT DISTINCT FROM b[i].role AND a[i].text IS NOT DISTINCT FROM b[i].text THEN NULL ELSE i - 1 END),
      lambda x: x IS NOT NULL)), len(a)) AS n FROM g),
d AS (
  SELECT pair_id, n, len(a) AS na, len(b) AS nb,
    list_transform(a, lambda t: {'role': t.role, 'head': '<|' || translate(coalesce(t.role, ''), '<|>' || chr(13) || chr(10), '_____') || '|>' || chr(10), 'body': replace(coalesce(t.text, ''), '<|', '< |') || '<|end|>' || chr(10)}) AS a,
    list_transform(b, lambda t: {'role': t.role, 'head': '<|' || translate(coalesce(t.role, ''), '<|>' || chr(13) || chr(10), '_____') || '|>' || chr(10), 'body': replace(coalesce(t.text, ''), '<|', '< |') || '<|end|>' || chr(10)}) AS b
  FROM p)
SELECT pair_id, CAST(n AS INTEGER) AS n_prefix, CAST(na AS INTEGER) AS chosen_turns, CAST(nb AS INTEGER) AS rejected_turns,
  coalesce(array_to_string(list_transform(a[1:n], lambda t: t.head || t.body), ''), '') AS prompt,
  CASE WHEN na > 0 THEN coalesce(array_to_string(list_transform(a[n + 1:], lambda t: t.head || t.body), ''), '') END AS chosen,
  CASE WHEN nb > 0 THEN coalesce(array_to_string(list_transform(b[n + 1:], lambda t: t.head || t.body), ''), '') END AS rejected,
  CASE WHEN na > 0 THEN coalesce(array_to_string(list_transform(a[n + 1:], lambda t: CASE WHEN t.role = 'assistant' THEN '0:' || length(t.head) || ' 1:' || length(t.body) ELSE '0:' || (length(t.head) + length(t.body)) END), ' '), '') END AS chosen_mask,
  CASE WHEN nb > 0 THEN coalesce(array_to_string(list_transform(b[n + 1:], lambda t: CASE WHEN t.role = 'assistant' THEN '0:' || length(t.head) || ' 1:' || length(t.body) ELSE '0:' || (length(t.head) + length(t.body)) END), ' '), '') END AS rejected_mask
FROM d
"""
