"""Character spans, as half-open code point ranges.

Texts are cut by built-in functions. What adds up the lengths is an Arrow function over whole batches, as
no built-in function gives running sums of an array in one pass; tokens are looked up in one walk over the text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textloom.deploy import ship
from textloom.functions.rx import col, rx_all

SPANS = "array<struct<start:int,end:int>>"
SPANS_TYPE = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

#: Code point ranges of East Asian scripts.
CJK_RANGES = ((4352, 4607), (11904, 42191), (43072, 43135), (44032, 55215), (63744, 64255), (65072, 65103), (65381, 65500), (131072, 196607))


def _added(lead: Column, size: Column, step: Column) -> Column:
    """Spans of ``size`` that begin ``lead`` after the sum of all steps before, from arrays of equal lengths."""
    ship()

    @F.arrow_udf(SPANS_TYPE)
    def run(lead: pa.Array, size: pa.Array, step: pa.Array) -> pa.Array:
        known = step.is_valid()
        counts = np.where(known, step.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
        ends = np.concatenate([[0], np.cumsum(counts)])
        steps, first, sizes = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (step, lead, size))
        total = np.concatenate([[0], np.cumsum(steps)])
        start = total[:-1] - np.repeat(total[ends[:-1]], counts) + first
        spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array((start + sizes).astype(np.int32))], ["start", "end"])
        offsets = pa.array(ends.astype(np.int32), mask=np.append(~known.to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(offsets, spans).cast(to_arrow_type(SPANS_TYPE))

    return run(lead, size, step)


def _looked_up(tokens: Column, text: Column, one) -> Column:
    """``one(tokens, text)``, a pair of spans (or null) and a lost token, for each row; null of null."""
    ship()
    kind = T.StructType([T.StructField("spans", SPANS_TYPE), T.StructField("lost", T.StringType())])
    out = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(tokens: pa.Array, texts: pa.Array) -> pa.Array:
        rows = []
        for own, text in zip(tokens.to_pylist(), texts.to_pylist(), strict=True):
            spans, lost = (None, None) if own is None or text is None else one(own, text)
            rows.append({"spans": spans if spans is None else [{"start": x, "end": y} for x, y in spans], "lost": lost})
        return pa.array(rows, out)

    return run(tokens, text)


def _between(pieces: Column, breaks: Column) -> Column:
    """Spans of ``pieces``, which ``breaks`` (one fewer) separate."""
    sizes = F.transform(pieces, lambda p: F.length(p))
    steps = F.zip_with(pieces, breaks, lambda p, b: F.length(p) + F.coalesce(F.length(b), F.lit(0)))
    return _added(F.transform(pieces, lambda p: F.lit(0)), sizes, steps)


def string_span_tokenize(text: Column | str, separator: str) -> Column:
    """Spans between literal separators. Empty ones are dropped; in a text with
    non-ASCII characters only those that end at 0 or at the text's end are."""
    if not separator:
        raise ValueError("Token delimiter must not be empty")
    c = col(text)
    pattern = re.escape(separator)
    all_spans = _between(F.split(c, pattern, -1), rx_all(c, pattern))
    plain = F.filter(all_spans, lambda s: s["start"] != s["end"])
    last = F.length(c)
    wide = F.filter(all_spans, lambda s: (s["end"] != 0) & ((s["start"] != s["end"]) | (s["end"] != last)))
    return F.when(F.octet_length(c) == F.length(c), plain).otherwise(wide)


def regexp_span_tokenize(text: Column | str, pattern: str) -> Column:
    """Spans between matches of ``pattern``; empty ones are dropped unless the only one is empty.

    For ``\\s+`` on ASCII text the spans are the runs without space, tab or line break characters, none for a blank text.
    """
    c = col(text)
    unicode = f"(?U){pattern}"
    every = _between(F.split(c, unicode, -1), rx_all(c, unicode))
    last = F.length(c)
    # an empty leading piece is never a span; the final one is, if nothing else is
    inner = F.filter(every, lambda s: s["start"] != s["end"])
    result = F.when(F.size(inner) > 0, inner).otherwise(F.array(F.struct(last.alias("start"), last.alias("end"))))
    if pattern == r"\s+":
        runs = F.filter(_between(F.split(c, r"[ \t\n\r]+", -1), rx_all(c, r"[ \t\n\r]+")), lambda s: s["start"] != s["end"])
        ascii_text = (F.octet_length(c) == last) & (c != "")
        return F.when(ascii_text, runs).otherwise(result)
    return result


def spans_to_relative(spans: Column | str) -> Column:
    """(offset from the end before, length) of each span."""
    c = col(spans)
    before = F.concat(F.array(F.lit(0)), F.transform(c, lambda s: s["end"]))
    pairs = F.zip_with(c, before, lambda s, e: F.when(s.isNotNull(), F.struct((s["start"] - e).alias("offset"), (s["end"] - s["start"]).alias("len"))))
    return F.filter(pairs, lambda x: x.isNotNull())


def align_tokens(tokens: Column | str, sentence: Column | str, strict: bool = True) -> Column:
    """Spans of tokens found one after the other. A token that is not there raises an error, or gives null unless ``strict``."""
    t, s = col(tokens), col(sentence)
    done = _looked_up(t, s, found_in_turn)
    error = F.raise_error(F.concat(F.lit('substring "'), done["lost"], F.lit('" not found in "'), s, F.lit('"')))
    bad = error.cast(SPANS) if strict else F.lit(None).cast(SPANS)
    return F.when(done["lost"].isNull(), done["spans"]).otherwise(bad)


def found_in_turn(tokens: list, text: str) -> tuple[list | None, str | None]:
    """(spans, None), or (None, the first token that is not there). Null tokens are passed over."""
    at, out = 0, []
    for token in tokens:
        if token is None:
            continue
        here = text.find(token, at)
        if here < 0:
            return None, token
        at = here + len(token)
        out.append((here, at))
    return out, None


def is_cjk(ch: Column | str) -> Column:
    """Whether the first code point is in one of ``CJK_RANGES``; false for an empty string."""
    code = F.ascii(col(ch))
    found = F.lit(False)
    for low, high in CJK_RANGES:
        found = found | code.between(low, high)
    return found


def regexp_match_spans(text: Column | str, pattern: str, gaps: bool = False) -> Column:
    """Spans of the matches of ``pattern``, or with ``gaps`` the non-empty ones between them."""
    c, unicode = col(text), f"(?U){pattern}"
    pieces, matches = F.split(c, unicode, -1), rx_all(c, unicode)
    if gaps:
        return F.filter(_between(pieces, matches), lambda s: s["start"] != s["end"])
    both = F.filter(F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("lead"), F.length(m).alias("size"))), lambda x: x["size"].isNotNull())
    return _added(F.transform(both, lambda x: x["lead"]), F.transform(both, lambda x: x["size"]), F.transform(both, lambda x: x["lead"] + x["size"]))


def char_spans(text: Column | str) -> Column:
    """One span for each code point."""
    places = F.filter(F.sequence(F.lit(0), F.length(col(text))), lambda i: i < F.length(col(text)))
    return F.transform(places, lambda i: F.struct(i.alias("start"), (i + 1).alias("end")))


def line_spans(text: Column | str, blanklines: str = "discard") -> Column:
    """Spans of lines: between single line breaks (keep), or between breaks with any blank lines after them."""
    return string_span_tokenize(text, "\n") if blanklines == "keep" else regexp_span_tokenize(text, r"\n(?:\s+\n)*")
