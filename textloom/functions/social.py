"""Tokens of social text: handles, hashtags, emoticons, links, telephone numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.rx import arrow, col, rx_all, rx_sub, swap

#: Named and quoted characters, in the order in which they are decoded.
ENTITIES = (
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#34;", '"'), ("&nbsp;", " "), ("&pound;", "£"),
    ("&copy;", "©"), ("&reg;", "®"), ("&euro;", "€"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&ldquo;", "“"), ("&rdquo;", "”"),
    ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&laquo;", "«"), ("&raquo;", "»"),
)

#: Patterns of the kinds of tokens, tried in this order. Classes stand where alternatives of single
#: characters would match the same, as repeated alternatives recurse deeply in Java.
EMOTICON = r"(?:[<>]?[:;=8][\-o\*']?[\)\]\(\[dDpP/:\}\{@\|\\]|[\)\]\(\[dDpP/:\}\{@\|\\][\-o\*']?[:;=8][<>]?|</?3)"
URL = r"(?:https?://[^\s<>\[\]{}()]+|[a-z0-9]+(?:[.\-][a-z0-9]+)*\.[a-z]{2,13}\b/?(?:[^\s()<>{}\[\]]+)?)"
PHONE = r"(?:\+?[01][ *\-.)]*\(?\d{3}[ *\-.)]*\d{3}[ *\-.)]*\d{4})"
TAG = r"<[^>\s]+>"
ARROW = r"[\-]+>|<[\-]+"
HANDLE = r"@[\w_]+"
HASHTAG = r"\#+[\w_]+[\w'_\-]*[\w_]+"
EMAIL = r"[\w.+\-]+@[\w\-]+\.(?:[\w\-]\.?)+[\w\-]"
EMOJI = r"(?:(?:[^\n]\x{200d}[^\n])+|[\x{1F3FB}-\x{1F3FF}])"
FLAG = r"(?:[\x{1F1E6}-\x{1F1FF}]{2})"
WORD = r"(?:[^\W\d_][[\w&&[^\d]]'\-]+[^\W\d_]|[+\-]?\d+[,/.:-]\d+[+\-]?|[\w_]+|\.(?:\s*\.){1,}|\S)"

_NUMERIC = re.compile(r"&#(x?)([0-9a-fA-F]+);")


def _character(m: re.Match) -> str:
    if not m[1] and not m[2].isdigit():
        return ""
    code = int(m[2], 16 if m[1] else 10)
    if 0x80 <= code <= 0x9F:
        return bytes([code]).decode("cp1252", "ignore")
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else ""


def _numbered(text: str) -> str:
    return _NUMERIC.sub(_character, text)


def unescape(text: Column | str, numeric: bool = True) -> Column:
    """Decode ``ENTITIES``, then numbered characters (80 to 9F hexadecimal as Windows-1252). Only ``numeric`` needs Python workers."""
    c = col(text)
    for name, ch in ENTITIES:
        c = swap(c, name, ch)
    # the other texts go to the function as nulls: a condition alone does not keep rows from it
    return F.coalesce(arrow(T.StringType(), _numbered)(F.when(F.contains(c, F.lit("&#")), c)), c) if numeric else c


def strip_handles(text: Column | str) -> Column:
    return rx_sub(col(text), r"(?U)(?<![\p{IsAlphabetic}\p{N}_!@#$%&*])@\w{1,15}\b", " ")


def reduce_lengthening(text: Column | str) -> Column:
    """Runs of more than three of a character become three."""
    return rx_sub(col(text), r"(?s)(.)\1{3,}", "$1$1$1")


def casual_tokenize(text: Column | str, preserve_case: bool = True, reduce_len: bool = False, strip_handles_: bool = False, match_phone_numbers: bool = True, numeric_entities: bool = True) -> Column:
    """Tokens of social text. Without ``preserve_case`` all but tokens with an emoticon are lower-cased."""
    c = unescape(text, numeric_entities)
    if strip_handles_:
        c = strip_handles(c)
    if reduce_len:
        c = reduce_lengthening(c)
    c = rx_sub(c, r"(?s)([^a-zA-Z0-9])\1{3,}", "$1$1$1")
    kinds = [URL, *([PHONE] if match_phone_numbers else []), EMOTICON, TAG, ARROW, HANDLE, HASHTAG, EMAIL, EMOJI, FLAG, WORD]
    tokens = rx_all(c, f"(?U)(?:{'|'.join(kinds)})")
    if preserve_case:
        return tokens
    return F.transform(tokens, lambda t: F.when(t.rlike(f"(?i){EMOTICON}"), t).otherwise(F.lower(t)))
