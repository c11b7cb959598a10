"""A general tokenizer of punctuation for many languages."""

from __future__ import annotations

from pyspark.sql import Column

from textloom.functions.rx import col, rx_sub, swap, trimmed, words

#: Opening and closing brackets and currency signs, as character classes.
OPENING = (
    r"[{\x{0f3a}\x{0f3c}\x{169b}\x{201a}\x{201e}\x{2045}\x{207d}\x{208d}\x{2329}\x{2768}\x{276a}\x{276c}\x{276e}\x{2770}\x{2772}\x{2774}\x{27c5}"
    r"\x{27e6}\x{27e8}\x{27ea}\x{27ec}\x{27ee}\x{2983}\x{2985}\x{2987}\x{2989}\x{298b}\x{298d}\x{298f}\x{2991}\x{2993}\x{2995}\x{2997}\x{29d8}\x{29da}"
    r"\x{29fc}\x{2e22}\x{2e24}\x{2e26}\x{2e28}\x{3008}\x{300a}\x{300c}\x{300e}\x{3010}\x{3014}\x{3016}\x{3018}\x{301a}\x{301d}\x{fd3e}\x{fe17}\x{fe35}"
    r"\x{fe37}\x{fe39}\x{fe3b}\x{fe3d}\x{fe3f}\x{fe41}\x{fe43}\x{fe47}\x{fe59}\x{fe5b}\x{fe5d}\x{ff08}\x{ff3b}\x{ff5b}\x{ff5f}\x{ff62}]"
)
CLOSING = (
    r"[\]\)}\x{0f3b}\x{0f3d}\x{169c}\x{2046}\x{207e}\x{208e}\x{232a}\x{2769}\x{276b}\x{276d}\x{276f}\x{2771}\x{2773}\x{2775}\x{27c6}"
    r"\x{27e7}\x{27e9}\x{27eb}\x{27ed}\x{27ef}\x{2984}\x{2986}\x{2988}\x{298a}\x{298c}\x{298e}\x{2990}\x{2992}\x{2994}\x{2996}\x{2998}\x{29d9}\x{29db}"
    r"\x{29fd}\x{2e23}\x{2e25}\x{2e27}\x{2e29}\x{3009}\x{300b}\x{300d}\x{300f}\x{3011}\x{3015}\x{3017}\x{3019}\x{301b}\x{301e}\x{301f}\x{fd3f}\x{fe18}"
    r"\x{fe36}\x{fe38}\x{fe3a}\x{fe3c}\x{fe3e}\x{fe40}\x{fe42}\x{fe44}\x{fe48}\x{fe5a}\x{fe5c}\x{fe5e}\x{ff09}\x{ff3d}\x{ff5d}\x{ff60}\x{ff63}]"
)
CURRENCY = (
    r"[$\x{00a2}\x{00a3}\x{00a4}\x{00a5}\x{058f}\x{060b}\x{09f2}\x{09f3}\x{09fb}\x{0af1}\x{0bf9}\x{0e3f}\x{17db}\x{20a0}-\x{20ba}"
    r"\x{a838}\x{fdfc}\x{fe69}\x{ff04}\x{ffe0}\x{ffe1}\x{ffe5}\x{ffe6}]"
)

#: Marks that get a space on either side, in two sets.
MARKS = r"،;؛¿!\"\])}»›”؟¡%٪°±©®।॥…"
OPENERS = r"({\[ˮ“‘„‚«‹「『"

# Spaces next to each other become one in the end, so steps that only set spaces and do not read those of
# one another share a pass. A look at a short class first spares most characters the long ones.
_COLON = ":(?!//)"
_ASKED = rf"\?(?=[ \t\n\r{MARKS}{OPENERS}]|{_COLON}|\z)"
_MARKED = rf"(?=[;!\"\])}}%({{\[:?\x{{80}}-\x{{10FFFF}}])(?:[{MARKS}{OPENERS}]|{_COLON}|{_ASKED})"
#: Characters that are replaced, in the order in which it happens.
_NAMED = (("& ", "&amp; "), ("\t", " &#9; "), ("|", " &#124; "))
_AROUND = rf"(?=[,.\-'`\x{{80}}-\x{{10FFFF}}])(?:['’`–—]|,{{2,}}|,(?![0-9])|-{{2,}}|\.{{2,}}|{CLOSING})"
_AFTER = rf"(?=[$\x{{80}}-\x{{10FFFF}}])(?:{OPENING}|{CURRENCY})"
_FINAL = r"(?U)(?<!\.)\.(?:(?=\s*\z)|\s*([\"'’»›”])(?=\s*\z))"


def _spaced(text: Column | str) -> Column:
    """The text with one or more spaces between its tokens."""
    c = rx_sub(swap(col(text), "\u00a0", " "), _MARKED, " $0 ")
    for old, new in _NAMED:
        c = swap(c, old, new)
    c = rx_sub(rx_sub(c, _AROUND, " $0 "), _AFTER, "$0 ")
    return rx_sub(c, _FINAL, " . $1")


def toktok_text(text: Column | str) -> Column:
    """The text with single spaces between its tokens."""
    return trimmed(rx_sub(_spaced(text), " {2,}", " "))


def toktok_tokenize(text: Column | str) -> Column:
    return words(_spaced(text))
