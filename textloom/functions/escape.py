"""XML escapes of the eight characters that sentence markup reserves."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.rx import col, swap

#: Fixed values, in the order of escaping.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;"), ("|", "&#124;"), ("[", "&#91;"), ("]", "&#93;"))


def xml_escape(text: Column | str) -> Column:
    c = col(text)
    for plain, escaped in ESCAPES:
        c = swap(c, plain, escaped)
    return c


def xml_unescape(text: Column | str) -> Column:
    """The inverse; ``&amp;`` goes last, so nothing is decoded twice."""
    c = col(text)
    for plain, escaped in reversed(ESCAPES):
        c = swap(c, escaped, plain)
    return c


def add(a: Column | str, b: Column | str) -> Column:
    """Sum of two 64-bit integers, wrapping around at the ends of their range."""
    half, whole = (F.lit(Decimal(1 << n)).cast("decimal(20,0)") for n in (63, 64))
    shifted = F.pmod(col(a).cast("decimal(20,0)") + col(b).cast("decimal(20,0)") + half, whole)
    return (shifted - half).cast("bigint")
