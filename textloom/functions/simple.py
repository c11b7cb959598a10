"""Splitters that need one pattern: spaces, tabs, characters, lines, paragraphs, regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.rx import col, filled, rx_all, rx_sub, trimmed, words

#: From this size in bytes on, paragraphs keep their outer white space.
LONG_TEXT_BYTES = 5000


def space_tokenize(text: Column | str) -> Column:
    """Split at every single space; empty tokens stay."""
    return F.split(col(text), " ", -1)


def tab_tokenize(text: Column | str) -> Column:
    """Split at every tab; empty tokens stay."""
    return F.split(col(text), "\t", -1)


def char_tokenize(text: Column | str) -> Column:
    """One token for each code point."""
    return rx_all(col(text), "(?s).")


def line_tokenize(text: Column | str, blanklines: str = "discard") -> Column:
    """Lines; one final line break counts for nothing. ``blanklines``: keep, discard or discard-eof (as discard)."""
    if blanklines not in ("discard", "keep", "discard-eof"):
        raise ValueError(f"blanklines must be discard, keep or discard-eof, not {blanklines!r}")
    lines = F.split(rx_sub(col(text), r"\n\z", ""), "\n", -1)
    lines = F.when(col(text) == "", F.array().cast("array<string>")).otherwise(lines)
    return lines if blanklines == "keep" else F.filter(lines, lambda x: x.rlike(r"(?U)\S"))


def whitespace_tokenize(text: Column | str) -> Column:
    return words(col(text))


def blankline_tokenize(text: Column | str) -> Column:
    """Paragraphs between blank lines. Those of texts under ``LONG_TEXT_BYTES`` are trimmed."""
    c = col(text)
    short = filled(F.transform(F.split(c, r"\n[ \t\r]*\n[ \t\r\n]*", -1), trimmed))
    return F.when(F.octet_length(c) < LONG_TEXT_BYTES, short).otherwise(filled(F.split(c, r"(?U)\s*\n\s*\n\s*", -1)))


def wordpunct_tokenize(text: Column | str) -> Column:
    """Runs of word characters, and runs of what is neither those nor white space."""
    return rx_all(col(text), r"(?U)\w+|[^\w\s]+")


def regexp_tokenize(text: Column | str, pattern: str, gaps: bool = False, discard_empty: bool = True) -> Column:
    """Whole matches of ``pattern`` (Java syntax, Unicode classes), or with ``gaps`` what lies between them."""
    if not gaps:
        return rx_all(col(text), f"(?U){pattern}")
    parts = F.split(col(text), f"(?U){pattern}", -1)
    return filled(parts) if discard_empty else parts
