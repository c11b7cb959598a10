"""Penn-Treebank-style word tokens: an ordered cascade of rewrites, then a split at white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.rx import col, rx_all, rx_sub, swap
from textloom.functions.sentences import SentenceModel, sent_tokenize

#: Words that are two tokens, as (first part, second part).
CONTRACTIONS = (("can", "not"), ("d", "'ye"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("more", "'n"), ("wan", "na"))

#: Bracket names.
BRACKETS = (("(", "-LRB-"), (")", "-RRB-"), ("[", "-LSB-"), ("]", "-RSB-"), ("{", "-LCB-"), ("}", "-RCB-"))

#: Patterns in the order in which they apply. A step without a pattern's
#: signs is a plain replacement, which costs less than a regular expression.
_OPENING = [
    (r"([«“‘„]|[`]+)", " $1 "),
    (r'\A"', "``"),
    ("``", " `` "),
    (r"([ \(\[{<])(\"|'{2})", "$1 `` "),
    (r"(?U)'(?![mtsdnMTSDN]\b)(\w)\b", "' $1"),
]
_PUNCTUATION = [
    (r"(?U)(?<=[^\.])\.([\]\[\)}>\"'»”’]*)\s*\z", " . $1 "),
    (r"(?U)([:,])([^\d])", " $1 $2"),
    (r"([:,])\z", " $1 "),
    ("...", " ... "),
    (r"[;@#$%&]", " $0 "),
    (r"(?U)(?<=[^\.])\.([\]\[\)}>\"']*)\s*\z", " .$1 "),
    (r"[?!]", " $0 "),
    (r"([^'])' ", "$1 ' "),
    (r"[*\]\[(){}<>]", " $0 "),
]
_CLOSING = [
    (r"[»”’]", " $0 "),
    ("''", " '' "),
    ('"', " '' "),
    (r"(?U) \s+|[\s&&[^ ]]\s*", " "),  # single spaces stay as they are
    (r"(?=')(?<=[^' ])'[sSmMdD]? ", " $0"),
    (r"(?=['nN])(?<=[^' ])(?:'ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", " $0"),
]
# all contractions in one pass: a first part counts only before its own second part
_FIRST = "|".join(rf"{a}(?={b}\b)" for a, b in CONTRACTIONS)
_SECOND = "|".join(sorted({b for _, b in CONTRACTIONS}))
_SPLIT = [(rf"(?=[cdglmwCDGLMW])(?iuU)\b({_FIRST})({_SECOND})\b", " $1 $2 "), (r"(?iuU) ('t)(is|was)\b", " $1 $2 ")]


def _steps(c: Column, steps: list[tuple[str, str]]) -> Column:
    for old, new in steps:
        c = swap(c, old, new) if old in ("``", "...", "''", '"') else rx_sub(c, old, new)
    return c


#: A sentence may end inside: an end mark, closers, white space, then a capital or the end.
#: Any character whose first UTF-8 byte reads as a Latin-1 capital counts as one.
_MAY_SPLIT = r"[.!?][\"')\]}]*[ \n\t\r][ \n\t]*(?:[A-Z\x{80}-\x{5BF}\x{600}-\x{7BF}]|\z)"


def treebank_tokenize(text: Column | str, convert_parentheses: bool = False) -> Column:
    """Word tokens of one line or sentence. With ``convert_parentheses`` brackets get their names."""
    c = _steps(_steps(col(text), _OPENING), _PUNCTUATION)
    if convert_parentheses:
        for mark, name in BRACKETS:
            c = swap(c, mark, name)
    c = F.concat(F.lit(" "), swap(c, "--", " -- "), F.lit(" "))
    return rx_all(_steps(_steps(c, _CLOSING), _SPLIT), "[^ ]+")  # all other white space is gone


def needs_sentence_split(text: Column | str) -> Column:
    c = col(text)
    return (F.octet_length(c) >= 3) & c.rlike(_MAY_SPLIT)


def word_tokenize(text: Column | str, convert_parentheses: bool = False, mode: str = "auto", preserve_line: bool = False, model: SentenceModel | None = None, language: str = "english") -> Column:
    """Word tokens of a text.

    ``mode`` auto splits sentences first only where the text may hold several, punkt always,
    line never (as ``preserve_line`` does).
    """
    if mode not in ("auto", "punkt", "line"):
        raise ValueError(f"mode must be auto, punkt or line, not {mode!r}")
    c = col(text)
    whole = treebank_tokenize(c, convert_parentheses)
    if preserve_line or mode == "line":
        return whole
    # texts that stay whole go to the sentence function as nulls
    sentences = sent_tokenize(c if mode == "punkt" else F.when(needs_sentence_split(c), c), model=model, language=language)
    split = F.flatten(F.transform(sentences, lambda s: treebank_tokenize(s, convert_parentheses)))
    alone = F.size(sentences) == 0 if mode == "punkt" else ~needs_sentence_split(c)
    return F.when(alone, whole).otherwise(split)


def word_spans(text: Column | str) -> Column:
    """Spans of the word tokens; a rewritten quote stands for whichever form the text has. Null where a token cannot be found."""
    from textloom.functions.spans import _looked_up

    c = col(text)
    return _looked_up(treebank_tokenize(c), c, _quoted_in_turn)["spans"]


def _quoted_in_turn(tokens: list, text: str) -> tuple[list | None, str | None]:
    """Spans of tokens found one after the other, quote tokens by any of their forms."""
    at, out = 0, []
    for token in tokens:
        if token in ("``", "''"):
            here, size = min(((k, len(q)) for q in ('"', "''", "``") if (k := text.find(q, at)) >= 0), default=(-1, 0))
        else:
            here, size = text.find(token, at), len(token)
        if here < 0:
            return None, token
        at = here + size
        out.append((here, at))
    return out, None
