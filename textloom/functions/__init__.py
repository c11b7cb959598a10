"""Column functions: a column of texts, tokens or spans in, a column out."""

from textloom.functions.detok import detokenize
from textloom.functions.escape import add, xml_escape, xml_unescape
from textloom.functions.mwe import mwe_text, mwe_tokenize
from textloom.functions.nist import nist_international_tokenize, nist_tokenize
from textloom.functions.sentences import SentenceModel, sent_spans, sent_tokenize
from textloom.functions.sexpr import sexpr_tokenize
from textloom.functions.simple import blankline_tokenize, char_tokenize, line_tokenize, regexp_tokenize, space_tokenize, tab_tokenize, whitespace_tokenize, wordpunct_tokenize
from textloom.functions.social import casual_tokenize
from textloom.functions.spans import align_tokens, is_cjk, regexp_span_tokenize, spans_to_relative, string_span_tokenize
from textloom.functions.syllables import legal_onsets, legality_tokenize, legality_with_onsets, sonority_tokenize
from textloom.functions.tiling import texttiling_tokenize
from textloom.functions.toktok import toktok_text, toktok_tokenize
from textloom.functions.words import needs_sentence_split, treebank_tokenize, word_spans, word_tokenize

__all__ = [
    "SentenceModel", "add", "align_tokens", "blankline_tokenize", "casual_tokenize", "char_tokenize", "detokenize", "is_cjk", "legal_onsets",
    "legality_tokenize", "legality_with_onsets", "line_tokenize", "mwe_text", "mwe_tokenize", "needs_sentence_split", "nist_international_tokenize",
    "nist_tokenize", "regexp_span_tokenize", "regexp_tokenize", "sent_spans", "sent_tokenize", "sexpr_tokenize", "sonority_tokenize", "space_tokenize",
    "spans_to_relative", "string_span_tokenize", "tab_tokenize", "texttiling_tokenize", "toktok_text", "toktok_tokenize", "treebank_tokenize",
    "whitespace_tokenize", "word_spans", "word_tokenize", "wordpunct_tokenize", "xml_escape", "xml_unescape",
]
