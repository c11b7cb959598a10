"""Tokens as machine translation evaluation counts them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.rx import col, rx_chain, rx_sub, swap, words

#: Entities in the order of decoding (an ampersand before quotes).
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'"))
_PUNCTUATION = r"([!#$%&()*+\-/:;<=>?@\[\\\]^_{|}~])"
_ALL_PUNCTUATION = r"([!#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~])"
_MARKS = [(r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2")]


def _prepared(text: Column) -> Column:
    c = swap(text, "<skipped>", "")
    for name, ch in ENTITIES:
        c = swap(c, name, ch)
    return swap(c, "\u2028", " ")


def nist_tokenize(text: Column | str, lowercase: bool = False, western_lang: bool = True) -> Column:
    """Punctuation apart, periods and commas unless between digits. Other than western text is only split at white space."""
    c = _prepared(col(text))
    if not western_lang:
        return words(c)
    c = F.concat(F.lit(" "), c, F.lit(" "))
    return words(rx_chain(rx_sub(F.lower(c) if lowercase else c, _PUNCTUATION, " $1 "), _MARKS))


def nist_international_tokenize(text: Column | str, lowercase: bool = False) -> Column:
    """All ASCII punctuation but quotes apart, and non-ASCII runs apart from ASCII ones."""
    c = F.concat(F.lit(" "), _prepared(col(text)), F.lit(" "))
    c = F.lower(c) if lowercase else c
    return words(rx_chain(c, [(r"([^\x00-\x7F]+)", " $1 "), (_ALL_PUNCTUATION, " $1 "), *_MARKS]))
