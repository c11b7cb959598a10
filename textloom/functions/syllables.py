"""Syllables by legal onsets and by sonority."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.rx import STRINGS, arrow, col, rx_all

VOWELS = "aeiouy"
#: Fixed value: an onset is legal if more than this share of words starts with it.
LEAST_SHARE = 0.001
#: Tiers of falling sonority, vowels first; ranks of other characters up to U+00FF and above.
TIERS = ("aeiouy", "lmnrw", "zvsf", "bcdgtkpqxhj")
OTHER_LATIN, OTHER = 10, -10


def _class(letters: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in letters)


def legality_tokenize(word: Column | str, vowels: str = VOWELS) -> Column:
    """Syllables when no onset is known: a run of vowels with the consonants after it; leading consonants stand alone."""
    c, v = col(word), _class(vowels)
    parts = rx_all(c, rf"(?i)[{v}]+[^{v}]*|^[^{v}]+")
    return F.when(c.rlike(r"\p{IsAlphabetic}"), parts).when(c.isNotNull(), F.array(c))


def legal_onsets(words: DataFrame, word_col: str = "word", vowels: str = VOWELS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(onset, n, total): the lower-cased consonants that start more than ``least_share`` of the words.

    One grouping with partial sums; there are fewer than ``1 / least_share`` rows.
    """
    onset = F.lower(F.regexp_extract(F.col(word_col), rf"(?is)\A[^{_class(vowels)}]*", 0))
    counts = words.where(F.col(word_col).isNotNull()).groupBy(onset.alias("onset")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).where((F.col("onset") != "") & (F.col("n") / F.col("total") > least_share))


def onset_syllables(word: str, onsets: Collection[str], vowels: str = VOWELS) -> list[str]:
    """Syllables with the longest legal onsets, found from the word's end."""
    if not any(c.isalpha() for c in word):
        return [word]
    is_vowel = lambda c: c.lower() in vowels
    parts, part, onset, nucleus, legal = [], "", "", False, False
    for c in reversed(word):
        if not nucleus:
            part, nucleus = c + part, is_vowel(c)
        elif c.lower() + onset in onsets:
            part, onset, legal = c + part, c.lower() + onset, True
        elif is_vowel(c) and not legal:
            part, onset = c + part, c.lower() + onset
        else:
            parts.append(part)
            part, onset, nucleus, legal = c, "", is_vowel(c), False
    return [part, *reversed(parts)]


def legality_with_onsets(text: Column | str, onsets: Collection[str], vowels: str = VOWELS) -> Column:
    """Syllables of all words of a text, given the legal onsets (see ``legal_onsets``)."""
    known = frozenset(onsets)

    return arrow(STRINGS, lambda t: [s for w in t.split() for s in onset_syllables(w, known, vowels)] if t else [""])(col(text))


def sonority_tokenize(word: Column | str, tiers: Sequence[str] = TIERS) -> Column:
    """Syllables that break before consonants of least sonority. Words of up to three characters stay whole."""
    c = col(word)
    chars = rx_all(c, "(?s).")

    def rank(ch: Column) -> Column:
        out = F.when(F.ascii(ch) > 255, OTHER).otherwise(OTHER_LATIN)
        for k, tier in reversed(list(enumerate(tiers))):
            both = sorted({x for t in tier for x in (t, t.upper())})
            out = F.when(ch.isin(*both), -k).otherwise(out)
        return out

    ranks = F.transform(chars, rank)
    vowels = sorted({x for t in tiers[0] for x in (t, t.upper())})
    places = F.filter(
        F.sequence(F.lit(1), F.length(c) - 2),
        lambda i: (F.get(ranks, i) < F.get(ranks, i - 1)) & (F.get(ranks, i) <= F.get(ranks, i + 1)) & ~F.get(chars, i).isin(*vowels),
    )
    starts, ends = F.concat(F.array(F.lit(0)), places), F.concat(places, F.array(F.length(c)))
    parts = F.transform(F.arrays_zip(starts, ends), lambda z: F.substring(c, z["0"] + 1, z["1"] - z["0"]))
    return F.when((F.length(c) > 3) & c.rlike(r"\p{IsAlphabetic}"), parts).when(c.isNotNull(), F.array(c))
