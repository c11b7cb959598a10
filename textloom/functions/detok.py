"""Joining Treebank tokens to a text again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.rx import col, rx_chain, swap, trimmed
from textloom.functions.words import BRACKETS

# Every pattern looks for its space first: that costs less than looking back at each character.
#: Spaces that go before and after contractions and closing quotes.
_CONTRACTIONS = r"(?= )(?:(?<=[^ \t]) (?='')|(?<=[^' ]) (?='(?:[sSmMdD]|ll|LL|re|RE|ve|VE)? )|(?<=[^' ]) (?=(?:n't|N'T) )|(?<![^ \t] '')(?<='') (?=[.,:)\]>};%]))"
#: Spaces that go around punctuation.
_SPACING = [
    (r"(?= \.)(?<![\[({<#$\])}>])(?<!``) \.\.\. ", "\x02"),
    (r"(?= )(?:(?<=[\[({<#$]) | (?=[\])}>?!;%:,])|(?<=[\])}>]) (?=[:;,.])|(?<!') (?='[ \x02])|(?<!\.) (?=\.[\])}>\[({<\"'`]* *\z)|(?<=``) )", ""),
    ("\x02", "..."),
]


def detokenize(tokens: Column | str, convert_parentheses: bool = False) -> Column:
    """The text of Treebank tokens. With ``convert_parentheses`` bracket names become brackets. No tokens give an empty text."""
    c = F.concat(F.lit(" "), F.array_join(col(tokens), " "), F.lit(" "))
    c = trimmed(swap(rx_chain(c, [(_CONTRACTIONS, "")]), "''", '"'))
    c = swap(c, " -- ", "--")
    if convert_parentheses:
        for mark, name in BRACKETS:
            c = swap(c, name, mark)
    c = trimmed(swap(rx_chain(c, _SPACING), "``", '"'))
    return F.when(F.size(col(tokens)) == 0, F.lit("")).otherwise(c)
