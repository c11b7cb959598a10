"""Merging multi-word expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.rx import col, rx_all, swap, words

_START, _GAP = "\x02", "\x01"


def mwe_tokenize(tokens: Column | str, expressions: Sequence[Sequence[str]], separator: str = "_") -> Column:
    """Tokens with the longest expression at each place merged, from left to right, without overlap.

    The tokens are joined with control characters 1 and 2, which they must not hold.
    """
    quote = lambda t: "\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    known = sorted({tuple(e) for e in expressions if e}, key=len, reverse=True)
    merged = "|".join(_GAP.join(_START + quote(t) for t in e) for e in known)
    pattern = (f"(?:{merged})(?={_GAP}|\\z)|" if merged else "") + f"{_START}[^{_GAP}]*"
    text = F.array_join(F.transform(col(tokens), lambda t: F.concat(F.lit(_START), t)), _GAP)
    return F.transform(rx_all(text, pattern), lambda t: swap(swap(t, _START, ""), _GAP, separator))


def mwe_text(text: Column | str, expressions: Sequence[Sequence[str]], separator: str = "_") -> Column:
    """The same for the white-space tokens of a text."""
    return mwe_tokenize(words(col(text)), expressions, separator)
