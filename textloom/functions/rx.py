"""Pattern helpers. Patterns are literals, so each is compiled once in a task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textloom.deploy import ship

SEPARATOR = "\x01"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def arrow(kind, one):
    """An Arrow function of one string column: ``one`` of each text, null of null."""
    ship()
    out = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None else one(t) for t in texts.to_pylist()], out)

    return run


STRINGS = T.ArrayType(T.StringType())


def rx_all(c: Column, pattern: str) -> Column:
    """All whole matches."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def rx_sub(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(replacement))


def rx_chain(c: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, replacement in steps:
        c = rx_sub(c, pattern, replacement)
    return c


def swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def words(c: Column) -> Column:
    """Runs without Unicode white space."""
    return rx_all(c, r"(?U)\S+")


def trimmed(c: Column) -> Column:
    """Without outer Unicode white space."""
    return rx_sub(c, r"(?U)\A\s+|\s+\z", "")


def filled(tokens: Column) -> Column:
    """Without empty strings."""
    return F.filter(tokens, lambda x: x != "")
