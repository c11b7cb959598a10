"""The registered queries of the text operators, with the SQL that checks them.

Token arrays are compared by their number and the MD5 of the tokens joined with
character 1. Where the SQL dialect has no look-around, the SQL uses an equivalent
for the characters that the tables hold.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom import functions as fn
from textloom.functions import aliases
from textloom.operators.tokenizers import paragraphs, tokenizer
from textloom.operators.tokens import token_counts

#: Fixed parameters of the queries.
EXPRESSIONS = (("of", "the"), ("in", "the"), ("on", "the", "of"), ("and", "the"), ("de", "la"))

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digest(rows: DataFrame, ids: list[str], tokens: Column) -> DataFrame:
    rows = rows.select(*ids, tokens.alias("t"))
    return rows.select(*ids, F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", "\x01")).alias("digest"))


_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}

DOCUMENTS = ("documents", ["doc_id"], "text")
TURNS = ("conversations", ["conv_id", "turn"], "text")
PAGES = ("pages", ["page_id"], "html")
URLS = ("pages", ["page_id"], "url")
PARTS = ("part", ["p_partkey"], "p_name")


def _tokens(name: str, where: tuple, function: Callable[[Column], Column], sql: str | None = None) -> None:
    """Register a query of token arrays. ``sql`` is a list expression over ``t``, the text."""
    table, ids, text = where
    _QUERIES[name] = lambda spark, d: _digest(_table(spark, d, table), ids, function(F.col(text)))
    if sql:
        own = ", ".join(ids)
        _SQL[name] = f"""SELECT {own}, CAST(len(l) AS BIGINT) AS n_tokens, md5(coalesce(array_to_string(l, chr(1)), '')) AS digest
            FROM (SELECT {own}, {sql} AS l FROM (SELECT {own}, {text} AS t FROM {table}))"""


def _text(name: str, where: tuple, function: Callable[[Column], Column], sql: str | None = None) -> None:
    """Register a query of one value for each row, ``out``."""
    table, ids, text = where
    _QUERIES[name] = lambda spark, d: _table(spark, d, table).select(*ids, function(F.col(text)).alias("out"))
    if sql:
        own = ", ".join(ids)
        _SQL[name] = f"SELECT {own}, {sql} AS out FROM (SELECT {own}, {text} AS t FROM {table})"


def _subs(expression: str, steps: list[tuple[str, str]]) -> str:
    """A chain of replacements in SQL."""
    for pattern, new in steps:
        quote = lambda s: s.replace("'", "''")
        expression = f"regexp_replace({expression}, '{quote(pattern)}', '{quote(new)}', 'g')"
    return expression


def _swaps(expression: str, pairs) -> str:
    for old, new in pairs:
        quote = lambda s: s.replace("'", "''")
        expression = f"replace({expression}, '{quote(old)}', '{quote(new)}')"
    return expression


_WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
_NOT_WORD_SPACE = r"[^\p{L}\p{M}\p{Nd}\p{Pc}\s]"

# simple splitters
_tokens("space_tokenize", DOCUMENTS, fn.space_tokenize, "string_split(t, ' ')")
_tokens("tab_tokenize", DOCUMENTS, fn.tab_tokenize, "string_split(t, chr(9))")
_tokens("char_tokenize", DOCUMENTS, fn.char_tokenize, "regexp_extract_all(t, '(?s).')")
_LINES = r"string_split(regexp_replace(t, '\n\z', ''), chr(10))"
_tokens("line_tokenize_keep", DOCUMENTS, lambda c: fn.line_tokenize(c, "keep"), f"CASE WHEN t = '' THEN [] ELSE {_LINES} END")
_tokens("line_tokenize", TURNS, fn.line_tokenize, f"list_filter({_LINES}, lambda x: regexp_matches(x, '\\S'))")
_tokens("line_tokenize_eof", TURNS, lambda c: fn.line_tokenize(c, "discard-eof"), f"list_filter({_LINES}, lambda x: regexp_matches(x, '\\S'))")
_tokens("whitespace_tokenize", DOCUMENTS, fn.whitespace_tokenize, r"regexp_extract_all(t, '\S+')")
_tokens("wordpunct_tokenize", DOCUMENTS, fn.wordpunct_tokenize, f"regexp_extract_all(t, '{_WORD}+|{_NOT_WORD_SPACE}+')")
_tokens("wordpunct_urls", URLS, fn.wordpunct_tokenize, f"regexp_extract_all(t, '{_WORD}+|{_NOT_WORD_SPACE}+')")
_tokens(
    "blankline_tokenize", PAGES, fn.blankline_tokenize,
    r"""CASE WHEN strlen(t) < 5000
        THEN list_filter(list_transform(regexp_split_to_array(t, '\n[ \t\r]*\n[ \t\r\n]*'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')
        ELSE list_filter(regexp_split_to_array(t, '\s*\n\s*\n\s*'), lambda x: x <> '') END""",
)
_tokens("regexp_tokenize_words", DOCUMENTS, lambda c: fn.regexp_tokenize(c, r"\w+"), f"regexp_extract_all(t, '{_WORD}+')")
_tokens("regexp_tokenize_digits", DOCUMENTS, lambda c: fn.regexp_tokenize(c, r"\d+"), r"regexp_extract_all(t, '\p{Nd}+')")
_tokens("regexp_tokenize_gaps", DOCUMENTS, lambda c: fn.regexp_tokenize(c, r"[.,!]\s*", gaps=True), r"list_filter(regexp_split_to_array(t, '[.,!]\s*'), lambda x: x <> '')")
_tokens("regexp_tokenize_gaps_keep", URLS, lambda c: fn.regexp_tokenize(c, "[/:.]", gaps=True, discard_empty=False), "regexp_split_to_array(t, '[/:.]')")

# escapes, scripts
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;"), ("|", "&#124;"), ("[", "&#91;"), ("]", "&#93;"))
_text("xml_escape", PAGES, lambda c: F.md5(fn.xml_escape(c)), f"md5({_swaps('t', _ESCAPES)})")
_text("xml_unescape", PAGES, lambda c: F.md5(fn.xml_unescape(c)), f"md5({_swaps('t', [(b, a) for a, b in reversed(_ESCAPES)])})")
_text("xml_round_trip", DOCUMENTS, lambda c: fn.xml_unescape(fn.xml_escape(c)) == c, "true")
_CJK = " OR ".join(f"unicode(x) BETWEEN {a} AND {b}" for a, b in ((4352, 4607), (11904, 42191), (43072, 43135), (44032, 55215), (63744, 64255), (65072, 65103), (65381, 65500), (131072, 196607)))
_text(
    "is_cjk", DOCUMENTS,
    lambda c: F.size(F.filter(fn.char_tokenize(F.concat(F.lit("漢"), c, F.lit("가x"))), fn.is_cjk)).cast("bigint"),
    f"CAST(len(list_filter(regexp_extract_all('漢' || t || '가x', '(?s).'), lambda x: {_CJK})) AS BIGINT)",
)

# spans
_shown = lambda spans: F.transform(spans, lambda s: F.concat(s["start"], F.lit("-"), s["end"]))


def _spans(name: str, where: tuple, function: Callable[[Column], Column], pieces: str, breaks: str, keep: str = "a <> b", matches: bool = False, shown: str = "a || '-' || b") -> None:
    """Register a query of spans. In SQL ``pieces`` and the ``breaks`` between them are lists over ``t``; a span (a, b) is a piece, or with ``matches`` a break."""
    _tokens(name, where, function)
    table, ids, text = where
    own = ", ".join(ids)
    place = "p + length(x) AS a, p + length(x) + length(g) AS b" if matches else "p AS a, p + length(x) AS b"
    _SQL[name] = f"""WITH c AS (SELECT {own}, {text} AS t FROM {table}),
        u AS (SELECT {own}, t, unnest({pieces}) AS x, unnest(list_append({breaks}, NULL)) AS g, generate_subscripts({pieces}, 1) AS i FROM c),
        r AS (SELECT *, CAST(coalesce(sum(length(x) + coalesce(length(g), 0)) OVER (PARTITION BY {own} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS p FROM u),
        s AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY {own} ORDER BY i) AS before FROM (SELECT *, {place} FROM r) WHERE {"g IS NOT NULL" if matches else keep}),
        l AS (SELECT {own}, list({shown} ORDER BY i) AS l FROM s GROUP BY {own})
        SELECT {own}, CAST(coalesce(len(l), 0) AS BIGINT) AS n_tokens, md5(coalesce(array_to_string(l, chr(1)), '')) AS digest FROM c LEFT JOIN l USING ({own})"""


_AT_SPACES = ("string_split(t, ' ')", "list_transform(range(1, len(string_split(t, ' '))), lambda i: ' ')")
# in a text with other than ASCII characters only what ends at 0 or is empty at the end goes
_KEPT = "CASE WHEN strlen(t) = length(t) THEN a <> b ELSE b <> 0 AND (a <> b OR b <> length(t)) END"
_spans("string_span_tokenize", DOCUMENTS, lambda c: _shown(fn.string_span_tokenize(c, " ")), *_AT_SPACES, keep=_KEPT)
_spans("spans_to_relative", DOCUMENTS, lambda c: F.transform(fn.spans_to_relative(fn.string_span_tokenize(c, " ")), lambda s: F.concat(s["offset"], F.lit("-"), s["len"])), *_AT_SPACES, keep=_KEPT, shown="(a - before) || '-' || (b - a)")
_spans("regexp_span_tokenize", DOCUMENTS, lambda c: _shown(fn.regexp_span_tokenize(c, r"\s+")), r"regexp_split_to_array(t, '\s+')", r"regexp_extract_all(t, '\s+')")
_spans("regexp_span_marks", DOCUMENTS, lambda c: _shown(fn.regexp_span_tokenize(c, "[.,!]+")), "regexp_split_to_array(t, '[.,!]+')", "regexp_extract_all(t, '[.,!]+')")
_spans("wordpunct_spans", DOCUMENTS, lambda c: _shown(tokenizer("wordpunct").spans(c)), f"regexp_split_to_array(t, '{_WORD}+|{_NOT_WORD_SPACE}+')", f"regexp_extract_all(t, '{_WORD}+|{_NOT_WORD_SPACE}+')", matches=True)
_spans("align_tokens", DOCUMENTS, lambda c: _shown(fn.align_tokens(F.filter(fn.space_tokenize(c), lambda x: x != ""), c)), *_AT_SPACES)
_QUERIES["word_spans"] = lambda spark, d: _digest(_table(spark, d, "documents"), ["doc_id"], F.transform(fn.word_spans("text"), lambda s: F.substring("text", s["start"] + 1, s["end"] - s["start"])))
_QUERIES["add"] = lambda spark, d: _table(spark, d, "orders").select("o_orderkey", fn.add("o_orderkey", F.lit(9223372036854775807)).alias("out"))
_SQL["add"] = "SELECT o_orderkey, CAST(CAST(o_orderkey AS HUGEINT) + 9223372036854775807 - CASE WHEN o_orderkey > 0 THEN 18446744073709551616::HUGEINT ELSE 0 END AS BIGINT) AS out FROM orders"

# Treebank words
_W_STEPS = [
    (r"([«“‘„]|[`]+)", r" \1 "), (r"\A" + '"', "``"), ("(``)", r" \1 "), (r"([ (\[{<])(" + '"' + r"|'{2})", r"\1 `` "),
    (r"([^.])(\.)([\]\[)}>" + '"' + r"'»”’]*)\s*\z", r"\1 \2 \3 "), (r"([:,])([^\p{Nd}])", r" \1 \2"), (r"([:,])\z", r" \1 "), (r"\.\.\.", r" \0 "), (r"[;@#$%&]", r" \0 "),
    (r"([^.])(\.)([\]\[)}>" + '"' + r"']*)\s*\z", r"\1 \2\3 "), (r"[?!]", r" \0 "), (r"([^'])' ", r"\1 ' "), (r"[*]", r" \0 "), (r"[\]\[(){}<>]", r" \0 "),
]
_BRACKETS = (("(", "-LRB-"), (")", "-RRB-"), ("[", "-LSB-"), ("]", "-RSB-"), ("{", "-LCB-"), ("}", "-RCB-"))
_W_CLOSE = [
    (r"([»”’])", r" \1 "), ("''", " '' "), ('"', " '' "), (r"\s+", " "), (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"\1 \2 "), (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 "),
]
# words that are two tokens: the dialect's word boundary is ASCII, so neighbours are named
_W_SPLIT = [(rf"(?i)(^|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}])({a})({b})($|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}])", r"\1 \2 \3 \4") for a, b in (("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na")) for _ in (0, 1)]


def _treebank_sql(text: str = "t", brackets: bool = False) -> str:
    inner = _subs(text, _W_STEPS)
    inner = _swaps(inner, _BRACKETS) if brackets else inner
    return rf"regexp_extract_all({_subs(_subs(f"(' ' || replace({inner}, '--', ' -- ') || ' ')", _W_CLOSE), _W_SPLIT)}, '\S+')"


_SQL["word_spans"] = f"""SELECT doc_id, CAST(len(l) AS BIGINT) AS n_tokens, md5(array_to_string(l, chr(1))) AS digest FROM (
    SELECT doc_id, list_transform({_treebank_sql()}, lambda x: CASE WHEN x IN ('``', repeat(chr(39), 2)) THEN chr(34) ELSE x END) AS l FROM (SELECT doc_id, text AS t FROM documents))"""
_tokens("word_tokenize_line", DOCUMENTS, fn.treebank_tokenize, _treebank_sql())
_tokens("word_tokenize_parentheses", DOCUMENTS, lambda c: fn.word_tokenize(c, convert_parentheses=True, preserve_line=True), _treebank_sql(brackets=True))
_tokens("word_tokenize_batch_gpu", TURNS, aliases.word_tokenize_batch_gpu, _treebank_sql())
_text("needs_sentence_split", DOCUMENTS, fn.needs_sentence_split, r"strlen(t) >= 3 AND regexp_matches(t, '[.!?][" + '"' + r"'')\]}]*[ \n\t\r][ \n\t]*(?:[A-Z\x{80}-\x{5BF}\x{600}-\x{7BF}]|\z)')")
_tokens("word_tokenize", DOCUMENTS, fn.word_tokenize)
_tokens("word_tokenize_batch", DOCUMENTS, aliases.word_tokenize_batch)
_tokens("sent_tokenize", DOCUMENTS, fn.sent_tokenize)
_tokens("sent_tokenize_turns", TURNS, fn.sent_tokenize)
_tokens("sentence_spans", DOCUMENTS, lambda c: F.transform(fn.sent_spans(c), lambda s: F.substring(c, s["start"] + 1, s["end"] - s["start"])))


def _relational_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.plans.sentences import sentence_table

    return sentence_table(_table(spark, sf_dir, "conversations").withColumn("id", F.struct("conv_id", "turn")), "id", "text").groupBy(F.col("id.conv_id").alias("conv_id"), F.col("id.turn").alias("turn")).agg(F.count("*").alias("n_sentences"))


_QUERIES["sentences_relational"] = _relational_sentences

# social text, toktok, machine translation evaluation
_EMOTICON = r"(?:[<>]?[:;=8][\-o\*'']?[\)\]\(\[dDpP/:\}\{@\|\\]|[\)\]\(\[dDpP/:\}\{@\|\\][\-o\*'']?[:;=8][<>]?|</?3)"
_ALNUM = r"[\p{L}\p{M}]"
_CASUAL = "|".join([
    r"(?:https?://[^\s<>\[\]{}()]+|[a-z0-9]+(?:[.\-][a-z0-9]+)*\.[a-z]{2,13}\b/?(?:[^\s()<>{}\[\]]+)?)",
    r"(?:\+?[01][ *\-.)]*\(?\d{3}[ *\-.)]*\d{3}[ *\-.)]*\d{4})",
    _EMOTICON, r"<[^>\s]+>", r"[\-]+>|<[\-]+", f"@{_WORD}+", rf"#+{_WORD}+[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}''\-]*{_WORD}+",
    rf"[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}.+\-]+@[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\-]+\.(?:[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\-]\.?)+[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\-]",
    rf"(?:{_ALNUM}(?:{_ALNUM}|[''\-_])+{_ALNUM}|[+\-]?\d+[,/.:-]\d+[+\-]?|{_WORD}+|\.(?:\s*\.)+|\S)",
])
_tokens("casual_tokenize", URLS, fn.casual_tokenize, f"regexp_extract_all(t, '{_CASUAL}')")
_tokens("casual_tokenize_turns", TURNS, fn.casual_tokenize, f"regexp_extract_all(t, '{_CASUAL}')")
_tokens("casual_tokenize_lower", TURNS, lambda c: fn.casual_tokenize(c, preserve_case=False), f"list_transform(regexp_extract_all(t, '{_CASUAL}'), lambda x: CASE WHEN regexp_matches(x, '(?i){_EMOTICON}') THEN x ELSE lower(x) END)")
# the dialect has no back references: a rule for each character that the tables hold
_RUNS = [(re.escape(ch) + "{4,}", ch.replace("\\", "\\\\") * 3) for ch in [*map(chr, range(32, 127)), "\n", *"éóèñçüêäößíàáâôîûúÉÀÄÖÜÑ"]]
_HANDLES = [(r"(^|[^\p{L}\p{M}\p{N}_!@#$%&*])@[\p{L}\p{M}\p{Nd}\p{Pc}]{1,15}($|[^\p{L}\p{M}\p{Nd}\p{Pc}])", r"\1 \2")] * 2
_tokens("casual_tokenize_reduced", DOCUMENTS, lambda c: fn.casual_tokenize(c, reduce_len=True, strip_handles_=True), f"regexp_extract_all({_subs(_subs('t', _HANDLES), _RUNS)}, '{_CASUAL}')")

_TOKTOK = [
    (r"([،;؛¿!" + '"' + r"\])}»›”؟¡%٪°±©®।॥…])", r" \1 "), (r"([({\[ˮ“‘„‚«‹「『])", r" \1 "), (r"& ", "&amp; "), (r"\t", " &#9; "), (r"\|", " &#124; "), (r"([{])", r"\1 "), (r"([\])}])", r" \1 "),
    (r"(,{2,})", r" \1 "),
]
_TOKTOK_MORE = [(r"(['’`])", r" \1 "), (" ` ` ", " `` "), (" ' ' ", " '' "), (r"([$£€¥])", r"\1 "), (r"([–—])", r" \1 "), (r"(-{2,})", r" \1 "), (r"(\.{2,})", r" \1 ")]
# a comma apart from others, unless a digit or comma follows: twice, as matches must not overlap
_COMMA = [(r"(^|[^,،])([,،])($|[^,،0-9])", r"\1 \2 \3")] * 2
_FINAL = [(r"(^|[^.])\.(\s*)\z", r"\1 . \2")]
_tokens("toktok_tokenize", DOCUMENTS, fn.toktok_tokenize, rf"regexp_extract_all({_subs(_subs(_subs(_subs('t', _TOKTOK), _COMMA), _TOKTOK_MORE), _FINAL)}, '\S+')")
_ENDS = r"^\s+|\s+$"
_TOKTOK_SQL = _subs(_subs(_subs(_subs("t", _TOKTOK), _COMMA), _TOKTOK_MORE), _FINAL)
_text("toktok_text", DOCUMENTS, lambda c: F.md5(fn.toktok_text(c)), f"md5({_subs(_TOKTOK_SQL, [(' {2,}', ' '), (_ENDS, '')])})")

_PUNCT = r"([!#$%&()*+\-/:;<=>?@\[\\\]^_{|}~])"
_ALL_PUNCT = r"([!#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~])"
_ENTITIES = (("<skipped>", ""), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'"))
_MARKS = [(r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2")]
_NIST = f"(' ' || {_swaps('t', _ENTITIES)} || ' ')"
_tokens("nist_tokenize", DOCUMENTS, fn.nist_tokenize, rf"regexp_extract_all({_subs(_NIST, [(_PUNCT, r' \1 '), *_MARKS])}, '\S+')")
_tokens("nist_tokenize_lower", PAGES, lambda c: fn.nist_tokenize(c, lowercase=True), rf"regexp_extract_all({_subs(f'lower({_NIST})', [(_PUNCT, r' \1 '), *_MARKS])}, '\S+')")
_tokens("nist_tokenize_other", PAGES, lambda c: fn.nist_tokenize(c, western_lang=False), rf"regexp_extract_all({_swaps('t', _ENTITIES)}, '\S+')")
_tokens("nist_international_tokenize", DOCUMENTS, fn.nist_international_tokenize, rf"regexp_extract_all({_subs(_NIST, [(r'([^\x00-\x7F]+)', r' \1 '), (_ALL_PUNCT, r' \1 '), *_MARKS])}, '\S+')")

# expressions, groups, joining
_tokens(
    "mwe_tokenize", DOCUMENTS, lambda c: fn.mwe_text(c, EXPRESSIONS),
    r"""list_transform(regexp_extract_all(replace(array_to_string(regexp_extract_all(t, '\S+'), ' ') || ' ', ' ', ' ' || chr(2)),
        '(?:on \x02the \x02of|of \x02the|in \x02the|and \x02the|de \x02la) |[^ \x02]+ '), lambda x: replace(rtrim(x, ' '), ' ' || chr(2), '_'))""",
)


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, nested groups and a group that follows a word at once."""
    text = F.format_string("%s (%s (%s)) %s(%d)", "p_name", "p_brand", "p_type", "p_type", "p_size")
    return _digest(_table(spark, sf_dir, "part"), ["p_partkey"], fn.sexpr_tokenize(text))


_QUERIES["sexpr_tokenize"] = _groups
_SQL["sexpr_tokenize"] = r"""SELECT p_partkey, CAST(len(l) AS BIGINT) AS n_tokens, md5(array_to_string(l, chr(1))) AS digest FROM (SELECT p_partkey,
    list_concat(list_concat(regexp_extract_all(p_name, '\S+'), ['(' || p_brand || ' (' || p_type || '))']), list_append(regexp_extract_all(p_type, '\S+'), '(' || p_size || ')')) AS l FROM part)"""
# spaces go one rule after the other: no two rules want the same space in these texts
_JOINS = [(r"([^ \t]) ('')", r"\1\2")]
_CLOSE_UP = [(r"([\[({<#$]) ", r"\1"), (r" ([\])}>?!;%:,])", r"\1"), (r"([\])}>]) \.", r"\1."), (r"([^.]) (\.[\])}>\[({<" + '"' + r"'`]* *)\z", r"\1\2"), ("`` ", "``")]
_DETOK = f"replace({_subs(_subs(chr(39) + ' ' + chr(39) + f' || array_to_string({_treebank_sql()}, chr(32)) || chr(32)', _JOINS), [(_ENDS, '')])}, repeat(chr(39), 2), chr(34))"
_DETOK = f"replace({_subs(_subs(f'replace({_DETOK}, {chr(39)} -- {chr(39)}, {chr(39)}--{chr(39)})', _CLOSE_UP), [(_ENDS, '')])}, '``', chr(34))"
_text("detokenize", DOCUMENTS, lambda c: F.md5(fn.detokenize(fn.treebank_tokenize(c))), f"md5({_DETOK})")
_text("detokenize_words", PARTS, lambda c: fn.detokenize(fn.treebank_tokenize(c)), "t")

# syllables, topics
_VOWELS = "aeiouy"
_tokens("legality_tokenize", PARTS, fn.legality_tokenize, f"regexp_extract_all(t, '(?i)[{_VOWELS}]+[^{_VOWELS}]*|^[^{_VOWELS}]+')")


def _onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "documents").select(F.explode(fn.whitespace_tokenize("text")).alias("word"))
    return fn.legal_onsets(words).select("onset", "n", "total")


_QUERIES["legal_onsets"] = _onsets
_SQL["legal_onsets"] = rf"""WITH w AS (SELECT unnest(regexp_extract_all(text, '\S+')) AS w FROM documents),
    c AS (SELECT lower(regexp_extract(w, '(?is)^[^{_VOWELS}]*')) AS onset, count(*) AS n FROM w GROUP BY 1), s AS (SELECT sum(n) AS total FROM c)
    SELECT onset, n, CAST(total AS BIGINT) AS total FROM c, s WHERE onset <> '' AND n / total > 0.001"""


def _with_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = _table(spark, sf_dir, "benchmark")
    words = bench.select(F.explode(fn.whitespace_tokenize("text")).alias("word"))
    onsets = [r["onset"] for r in fn.legal_onsets(words).select("onset").collect()]  # fewer than 1,000 by definition
    return _digest(bench, ["item_id"], fn.legality_with_onsets(F.col("text"), onsets))


_QUERIES["legality_with_corpus"] = _with_corpus
_RANK = "CASE WHEN unicode(x) > 255 THEN -10 WHEN x IN ('a','e','i','o','u','y') THEN 0 WHEN x IN ('l','m','n','r','w') THEN -1 WHEN x IN ('z','v','s','f') THEN -2 WHEN x IN ('b','c','d','g','t','k','p','q','x','h','j') THEN -3 ELSE 10 END"
_QUERIES["sonority_tokenize"] = lambda spark, d: _table(spark, d, "benchmark").select(F.explode(F.array_distinct(fn.wordpunct_tokenize("text"))).alias("word")).distinct().select("word", F.array_join(fn.sonority_tokenize("word"), "|").alias("syllables"))
_SQL["sonority_tokenize"] = f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_WORD}+|{_NOT_WORD_SPACE}+')) AS word FROM benchmark),
    r AS (SELECT word, regexp_extract_all(word, '(?s).') AS ch, list_transform(regexp_extract_all(lower(word), '(?s).'), lambda x: {_RANK}) AS r FROM w)
    SELECT word, CASE WHEN length(word) <= 3 OR NOT regexp_matches(word, '\\p{{L}}') THEN word ELSE
      array_to_string(list_transform(ch, lambda c, i: CASE WHEN i > 1 AND i < len(ch) AND r[i] < r[i - 1] AND r[i] <= r[i + 1] AND lower(c) NOT IN ('a','e','i','o','u','y') THEN '|' || c ELSE c END), '') END AS syllables FROM r"""
_tokens("texttiling_tokenize", DOCUMENTS, fn.texttiling_tokenize)
_tokens("texttiling_short", PARTS, fn.texttiling_tokenize, "[trim(t)]")

_tokens("paragraphs", TURNS, paragraphs, r"list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')")
_tokens("char_spans", PARTS, lambda c: _shown(tokenizer("char").spans(c)), "list_transform(range(0, length(t)), lambda i: CAST(i AS VARCHAR) || '-' || CAST(i + 1 AS VARCHAR))")
_tokens("line_spans", DOCUMENTS, lambda c: F.transform(tokenizer("line").spans(c), lambda s: F.substring(c, s["start"] + 1, s["end"] - s["start"])), r"list_filter(string_split(t, chr(10)), lambda x: x <> '')")

# corpus-wide
_QUERIES["ws_top_tokens"] = lambda spark, d: token_counts(_table(spark, d, "documents"), fn.whitespace_tokenize).orderBy(F.desc("n"), "token").limit(20)
_SQL["ws_top_tokens"] = r"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\S+')) AS token FROM documents) GROUP BY 1 ORDER BY n DESC, token LIMIT 20"
_QUERIES["vocabulary"] = lambda spark, d: token_counts(_table(spark, d, "documents"), fn.wordpunct_tokenize).agg(F.count("*").alias("n_types"), F.sum("n").alias("n_tokens"), F.max("n").alias("most"))
_SQL["vocabulary"] = f"SELECT count(*) AS n_types, CAST(sum(n) AS BIGINT) AS n_tokens, max(n) AS most FROM (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_WORD}+|{_NOT_WORD_SPACE}+')) AS w FROM documents) GROUP BY 1)"
_QUERIES["toxic_token_counts"] = lambda spark, d: _table(spark, d, "documents").select("doc_id", F.size(fn.whitespace_tokenize("text")).alias("n")).join(_table(spark, d, "labels"), "doc_id").groupBy("toxic").agg(F.count("*").alias("docs"), F.sum("n").alias("n_tokens"))
_SQL["toxic_token_counts"] = r"SELECT toxic, count(*) AS docs, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS n_tokens FROM documents JOIN labels USING (doc_id) GROUP BY 1"


def _unlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of documents that the benchmark lacks: an anti join against a distinct vocabulary."""
    listed = _table(spark, sf_dir, "benchmark").select(F.explode(fn.whitespace_tokenize("text")).alias("token")).distinct()
    return token_counts(_table(spark, sf_dir, "documents"), fn.whitespace_tokenize).join(listed, "token", "left_anti")


def _source_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent tokens of each source."""
    rows = _table(spark, sf_dir, "documents").select("source", F.explode(fn.whitespace_tokenize("text")).alias("token")).groupBy("source", "token").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "token"))
    return rows.withColumn("rank", rank).where("rank <= 3")


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, tokens and distinct tokens by language and source, with subtotals of tokens."""
    rows = _table(spark, sf_dir, "documents").select("lang", "source", F.size(fn.whitespace_tokenize("text")).alias("n"))
    return rows.rollup("lang", "source").agg(F.count("*").alias("docs"), F.sum("n").alias("n_tokens"))


_UNNESTED = r"(SELECT source, unnest(regexp_extract_all(text, '\S+')) AS token FROM documents)"
_QUERIES |= {"unlisted_tokens": _unlisted, "source_top_tokens": _source_top, "token_rollup": _rollup}
_SQL |= {
    "unlisted_tokens": rf"SELECT token, count(*) AS n FROM {_UNNESTED} WHERE token NOT IN (SELECT unnest(regexp_extract_all(text, '\S+')) FROM benchmark) GROUP BY 1",
    "source_top_tokens": f"SELECT source, token, n, CAST(rank AS INTEGER) AS rank FROM (SELECT source, token, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, token) AS rank FROM {_UNNESTED} GROUP BY 1, 2) WHERE rank <= 3",
    "token_rollup": r"SELECT lang, source, count(*) AS docs, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS n_tokens FROM documents GROUP BY ROLLUP (lang, source)",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
