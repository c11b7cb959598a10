"""Sentence segmentation with a trained model, one text at a time.

Only tokens that end in ``. ? !`` can end a sentence, so only the chunks of text that
hold one of these are cut into tokens, each with the token that follows it. Reading one
text at a time, the operator runs on streams as well; ``textloom.plans.sentences``
has the same rules as relational operators.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import types as T

from textloom.functions.rx import STRINGS, arrow, col

#: Types that end in a period without ending a sentence.
ABBREVIATIONS = (
    "ct", "m.j", "t", "a.c", "n.h", "ms", "p.a.m", "dr", "pa", "p.m", "u.k", "st", "dec", "u.s.a", "lt", "g.k", "adm", "p", "h.m", "ga", "tenn", "yr",
    "sen", "n.c", "j.j", "d.h", "s.g", "inc", "vs", "s.p.a", "a.t", "n", "feb", "sr", "jan", "s.a.y", "n.y", "col", "g.f", "c.o.m.b", "d", "ft", "va",
    "r.k", "e.f", "chg", "r.i", "a.g", "minn", "a.h", "k", "n.j", "m", "l.f", "f.j", "gen", "i.m.s", "s.a", "aug", "j.p", "okla", "m.d.c", "ltd",
    "oct", "s", "vt", "r.a", "j.c", "ariz", "w.w", "b.v", "ore", "h", "w.r", "e.h", "mrs", "cie", "corp", "w", "n.v", "a.d", "r.j", "ok", ". .",
    "e.m", "w.c", "ill", "nov", "u.s", "prof", "conn", "u.s.s.r", "mg", "f.g", "ph.d", "g", "calif", "messrs", "h.f", "wash", "tues", "sw", "bros",
    "u.n", "l", "wis", "mr", "sep", "d.c", "ave", "e.l", "co", "s.s", "reps", "c", "r.t", "h.c", "r", "wed", "a.s", "v", "fla", "jr", "r.h", "c.v",
    "m.b.a", "rep", "a.a", "e", "c.i.t", "l.a", "b.f", "j.b", "d.w", "j.k", "ala", "f", "w.va", "sept", "mich", "n.m", "j.r", "l.p", "s.c", "colo",
    "fri", "a.m", "g.d", "kan", "maj", "ky", "a.m.e", "n.d", "t.j", "cos", "nev",
)

#: Pairs of types around a period that is no sentence's end.
COLLOCATIONS = (
    ("##number##", "international"), ("##number##", "rj"), ("##number##", "commodities"), ("##number##", "cooper"), ("b", "stewart"),
    ("##number##", "genentech"), ("##number##", "wedgestone"), ("i", "toussie"), ("##number##", "pepper"), ("j", "fialka"), ("o", "ludcke"),
    ("##number##", "insider"), ("##number##", "aes"), ("i", "magnin"), ("##number##", "credit"), ("##number##", "corrections"),
    ("##number##", "financing"), ("##number##", "henley"), ("##number##", "business"), ("##number##", "pay-fone"), ("b", "wigton"), ("b", "edelman"),
    ("b", "levine"), ("##number##", "leisure"), ("b", "smith"), ("j", "walter"), ("##number##", "pegasus"), ("##number##", "dividend"), ("j", "aron"),
    ("##number##", "review"), ("##number##", "abreast"), ("##number##", "who"), ("##number##", "letters"), ("##number##", "colgate"),
    ("##number##", "cbot"), ("##number##", "notable"), ("##number##", "zimmer"),
)

#: Types that often start a sentence.
SENTENCE_STARTERS = (
    "most", "he", "since", "so", "both", "these", "it", "nevertheless", "this", "indeed", "however", "instead", "under", "similarly", "some",
    "though", "while", "when", "in", "despite", "although", "nonetheless", "thus", "there", "if", "the", "nor", "separately", "moreover", "but",
    "they", "yet", "many", "according", "sales", "among", "meanwhile", "even", "i",
)

#: Bits of the orthographic contexts of a type: capital at a sentence's
#: beginning, middle, unknown place; then lower case at the same places.
BEG_UC, MID_UC, UNK_UC, BEG_LC, MID_LC, UNK_LC = 2, 4, 8, 16, 32, 64
UC, LC = BEG_UC | MID_UC | UNK_UC, BEG_LC | MID_LC | UNK_LC

#: Marks before which no sentence starts.
MARKS = (";", ":", ",", ".", "!", "?", '"', "'", "``", "''", "(", ")", "[", "]", "{", "}", "<", ">")

#: The name of numbers, and the patterns of tokens and of the text around them.
NUMBER = "##number##"
_SPACE = r"[^\S\x1c-\x1f]"
_MULTI = rf"(?:-{{2,}}|\.{{2,}}|(?:\.(?!\n){_SPACE}){{2,}}\.)"
_NO_WORD = r"""[)";}\]*:@'({\[?!]"""
_START = r"""[^\("\\`{\[:;&#*@)}\]\-,]"""
_END = rf"(?={_SPACE}|\Z|{_NO_WORD}|{_MULTI}|,(?=\Z|{_SPACE}|{_NO_WORD}|{_MULTI}))"
_TOKEN = re.compile(rf"{_MULTI}|(?={_START})(?:(?!{_SPACE}).)+?{_END}|(?!{_SPACE}).", re.S)
_CHUNK = re.compile(rf"(?:(?!{_SPACE})[^.?!])*[.?!](?:(?!{_SPACE}).)*", re.S)
_VISIBLE = re.compile(rf"(?!{_SPACE}).", re.S)
_SPREAD_DOTS = re.compile(rf"\.{_SPACE}\.")
_NUMERIC = re.compile(r"-?[.,]?\d[\d,.\-]*\.?\Z")
_ELLIPSIS = re.compile(r"\.\.+\Z")
_INITIAL = re.compile(r"[^\W\d]\.\Z")
_CLOSERS = re.compile(rf"[\"')\]}}]+(?:{_SPACE}+|\Z)")


@dataclass(frozen=True)
class SentenceModel:
    """What segmentation knows: three short lists, and the contexts in which types were seen, as bits.

    Contexts are many; give those of a trained model, or learn them from a corpus with
    ``textloom.plans.sentences.learn_contexts``.
    """

    abbreviations: frozenset = frozenset(ABBREVIATIONS)
    collocations: frozenset = frozenset(COLLOCATIONS)
    starters: frozenset = frozenset(SENTENCE_STARTERS)
    contexts: Mapping = field(default_factory=dict, hash=False)

    @staticmethod
    def load(path: str, **lists) -> SentenceModel:
        """A model with the contexts of a text file of lines ``type<TAB>bits``."""
        with open(path, encoding="utf-8") as f:
            rows = (line.rstrip("\n").rpartition("\t") for line in f)
            return SentenceModel(contexts={t: int(bits) for t, _, bits in rows if bits}, **lists)

    def cleared(self) -> SentenceModel:
        """This model without any context."""
        return replace(self, contexts={})

    def with_contexts(self, more: Mapping) -> SentenceModel:
        """This model with the bits of ``more`` added to those of each type."""
        return replace(self, contexts={t: self.contexts.get(t, 0) | more.get(t, 0) for t in {**self.contexts, **more}})

    def is_abbreviation(self, token: str) -> bool:
        stem = token[:-1].lower()
        return stem in self.abbreviations or stem.rpartition("-")[2] in self.abbreviations


class Token:
    """A token with the marks of the first pass."""

    __slots__ = ("abbreviation", "breaks", "ellipsis", "text", "type")

    def __init__(self, text: str, model: SentenceModel) -> None:
        self.text = text
        self.type = NUMBER if _NUMERIC.match(text) else text.lower()
        self.breaks = self.abbreviation = self.ellipsis = False
        if text in (".", "?", "!"):
            self.breaks = True
        elif _ELLIPSIS.search(text):
            self.ellipsis = True
        elif text.endswith("."):
            self.abbreviation = model.is_abbreviation(text)
            self.breaks = not self.abbreviation

    @property
    def bare_type(self) -> str:
        return self.type[:-1] if len(self.type) > 1 and self.type.endswith(".") else self.type

    @property
    def own_type(self) -> str:
        return self.bare_type if self.breaks else self.type


def starts_sentence(token: Token, model: SentenceModel) -> bool | None:
    """What the spelling of ``token`` says about a sentence starting there."""
    if token.text in MARKS:
        return False
    seen = model.contexts.get(token.own_type, 0)
    if token.text[0].isupper():
        return True if seen & LC and not seen & MID_UC else None
    if token.text[0].islower() and (seen & UC or not seen & BEG_LC):
        return False
    return None


def breaks_before(token: Token, following: Token, model: SentenceModel) -> bool:
    """The second pass: whether a sentence ends between two neighbours."""
    if not token.text.endswith("."):
        return token.breaks
    if (token.bare_type, following.own_type) in model.collocations:
        return False
    initial = _INITIAL.match(token.text) is not None
    capital = following.text[0].isupper()
    if (token.abbreviation or token.ellipsis) and not initial:
        if starts_sentence(following, model) or capital and following.own_type in model.starters:
            return True
    if initial or token.bare_type == NUMBER:
        verdict = starts_sentence(following, model)
        lower_seen = model.contexts.get(following.own_type, 0) & LC
        if verdict is False or verdict is None and initial and capital and not lower_seen:
            return False
    return token.breaks


def break_ends(text: str, model: SentenceModel) -> list[int]:
    """Ends of the tokens that end a sentence."""
    ends = []
    if _SPREAD_DOTS.search(text):
        pieces = [(m.end(), m[0]) for m in _TOKEN.finditer(text)]
        for (end, own), after in zip(pieces, [*pieces[1:], None], strict=True):
            token = Token(own, model)
            if (breaks_before(token, Token(after[1], model), model) if after else token.breaks):
                ends.append(end)
        return ends
    for chunk in _CHUNK.finditer(text):
        at, stop = chunk.start(), chunk.end()
        held = _TOKEN.match(text, at)
        while held:
            end = held.end()
            after = None
            if end < stop:
                after = _TOKEN.match(text, end)
            else:
                visible = _VISIBLE.search(text, end)
                after = visible and _TOKEN.match(text, visible.start())
            if held[0][-1] in ".?!":
                token = Token(held[0], model)
                if (breaks_before(token, Token(after[0], model), model) if after else token.breaks):
                    ends.append(end)
            if end >= stop:
                break
            held = after
    return ends


def sentence_spans(text: str, model: SentenceModel, realign: bool = True) -> list[tuple[int, int]]:
    """[start, end) of each sentence, trimmed. With ``realign``, closing marks go to the sentence before them."""
    body = text.rstrip()
    if not body:
        return []
    slices, start = [], len(text) - len(text.lstrip())
    for end in break_ends(text, model):
        slices.append([start, end])
        visible = _VISIBLE.search(text, end)
        start = visible.start() if visible else len(text)
    if start < len(body):
        slices.append([start, len(body)])
    if realign:
        for k in range(len(slices) - 1):
            closers = _CLOSERS.match(text, slices[k + 1][0])
            if closers:
                slices[k][1] = slices[k + 1][0] + len(closers[0].rstrip())
                slices[k + 1][0] = closers.end()
    out = []
    for start, end in slices:
        part = text[start:end]
        lead = len(part) - len(part.lstrip())
        if part.strip():
            out.append((start + lead, start + len(part.rstrip())))
    return out or [(len(text) - len(text.lstrip()), len(body))]


DEFAULT = SentenceModel()
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


#: Session setting: a file for ``SentenceModel.load``, whose contexts calls without a model then use.
CONTEXTS = "spark.textloom.sentence.contexts"


@lru_cache(maxsize=8)
def _loaded(path: str) -> SentenceModel:
    return SentenceModel.load(path)


def chosen(model: SentenceModel | None = None, language: str = "english") -> SentenceModel:
    """``model``, or that of the session's setting, or ``DEFAULT``. Only English is built in: another language warns."""
    if model is None and language != "english":
        warnings.warn(f"no sentence model for {language!r} is built in; the English one is used. Give one as model=", stacklevel=3)
    session = SparkSession.getActiveSession()
    path = session.conf.get(CONTEXTS, None) if session else None
    return model or (_loaded(path) if path else DEFAULT)


def _column(text: Column | str, model: SentenceModel, realign: bool, spans: bool) -> Column:
    if spans:
        return arrow(SPANS, lambda t: [{"start": a, "end": b} for a, b in sentence_spans(t, model, realign)])(col(text))
    return arrow(STRINGS, lambda t: [t[a:b] for a, b in sentence_spans(t, model, realign)])(col(text))


def sent_tokenize(text: Column | str, model: SentenceModel | None = None, realign_boundaries: bool = True, language: str = "english") -> Column:
    """Sentences of a text; none if it is blank."""
    return _column(text, chosen(model, language), realign_boundaries, False)


def sent_spans(text: Column | str, model: SentenceModel | None = None, realign_boundaries: bool = True, language: str = "english") -> Column:
    """Code point spans of the sentences."""
    return _column(text, chosen(model, language), realign_boundaries, True)
