"""Tokenizers as objects: one interface over the column functions, with their options bound."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import functions as fn
from textloom.functions import spans as sp


@dataclass(frozen=True)
class Tokenizer:
    """``column`` gives tokens, ``spans`` their places; ``transform`` adds the tokens to a table of texts."""

    column: Callable[[Column], Column]
    places: Callable[[Column], Column] | None = None

    def spans(self, text: Column) -> Column:
        """Code point spans; where the tokens alone tell, found one after the other, null if one cannot be."""
        return self.places(text) if self.places else sp.align_tokens(self.column(text), text, strict=False)

    def transform(self, docs: DataFrame, text_col: str = "text", out_col: str = "tokens") -> DataFrame:
        return docs.withColumn(out_col, self.column(F.col(text_col)))


def tokenizer(name: str, **options) -> Tokenizer:
    """A tokenizer by name, with the options of its column function."""
    bind = lambda f: lambda c: f(c, **options)
    kinds: dict[str, tuple[Callable, Callable | None]] = {
        "space": (fn.space_tokenize, lambda c: fn.string_span_tokenize(c, " ")),
        "tab": (fn.tab_tokenize, lambda c: fn.string_span_tokenize(c, "\t")),
        "char": (fn.char_tokenize, sp.char_spans),
        "line": (fn.line_tokenize, bind(sp.line_spans)),
        "whitespace": (fn.whitespace_tokenize, lambda c: sp.regexp_match_spans(c, r"\S+")),
        "wordpunct": (fn.wordpunct_tokenize, lambda c: sp.regexp_match_spans(c, r"\w+|[^\w\s]+")),
        "blankline": (fn.blankline_tokenize, None),
        "regexp": (fn.regexp_tokenize, lambda c: sp.regexp_match_spans(c, options["pattern"], options.get("gaps", False))),
        "treebank": (fn.treebank_tokenize, fn.word_spans),
        "word": (fn.word_tokenize, None),
        "sentence": (fn.sent_tokenize, bind(fn.sent_spans)),
        "casual": (fn.casual_tokenize, None),
        "toktok": (fn.toktok_tokenize, None),
        "nist": (fn.nist_tokenize, None),
        "nist_international": (fn.nist_international_tokenize, None),
        "mwe": (fn.mwe_text, None),
        "sexpr": (fn.sexpr_tokenize, None),
        "legality": (fn.legality_tokenize, None),
        "sonority": (fn.sonority_tokenize, None),
        "texttiling": (fn.texttiling_tokenize, None),
    }
    column, places = kinds[name]
    return Tokenizer(bind(column), places)


def paragraphs(text: Column | str) -> Column:
    """Texts between empty lines, trimmed, without empty ones."""
    from textloom.functions.rx import col, filled, trimmed

    return filled(F.transform(F.split(col(text), "\n\n", -1), trimmed))
