"""Further names of the column functions, as existing programs call them: ``*_py``, ``*_batch``, ``*_gpu`` and ``*_batch_gpu``.

On a DataFrame a batch is a column, so all of these are the plain functions; only word
tokens differ between single, batch and device batch calls.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame

from textloom import functions as fn

sent_tokenize_batch = sent_tokenize_batch_gpu = fn.sent_tokenize
word_tokenize_batch = partial(fn.word_tokenize, mode="punkt")
word_tokenize_batch_gpu = partial(fn.word_tokenize, mode="line")
word_tokenize_span = fn.word_spans


def legality_tokenize_with_corpus_py(word: Column | str, corpus: DataFrame) -> Column:
    """Syllables by the onsets that ``corpus``, a table of words (column ``word``), holds. Fewer than 1,000 onsets reach the driver, by definition."""
    return fn.legality_with_onsets(word, [r["onset"] for r in fn.legal_onsets(corpus).select("onset").collect()])


_SINGLE = (
    "string_span_tokenize", "regexp_span_tokenize", "spans_to_relative", "is_cjk", "xml_escape", "xml_unescape", "align_tokens", "casual_tokenize",
    "toktok_tokenize", "mwe_tokenize", "sexpr_tokenize", "detokenize", "space_tokenize", "tab_tokenize", "char_tokenize", "line_tokenize", "blankline_tokenize",
    "wordpunct_tokenize", "whitespace_tokenize", "nist_tokenize", "nist_international_tokenize", "legality_tokenize", "sonority_tokenize", "texttiling_tokenize",
)
_BATCH = (
    "regexp_tokenize", "casual_tokenize", "toktok_tokenize", "wordpunct_tokenize", "whitespace_tokenize", "detokenize", "nist_tokenize", "regexp_span_tokenize",
    "string_span_tokenize", "xml_escape", "xml_unescape",
)

globals().update({f"{name}_py": getattr(fn, name) for name in _SINGLE})
globals().update({f"{name}_gpu": getattr(fn, name) for name in (*_SINGLE, "word_tokenize", "sent_tokenize", "regexp_tokenize")})
globals().update({f"{name}_batch_gpu": getattr(fn, name) for name in _BATCH})
