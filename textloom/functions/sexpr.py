"""Top-level groups of balanced parentheses."""

from __future__ import annotations

import re

from pyspark.sql import Column

from textloom.functions.rx import STRINGS, arrow, col


def groups(text: str, parens: str = "()", strict: bool = True) -> list[str]:
    """Each top-level group as it stands, and the words outside. Unless ``strict``, a stray
    closing mark is a token and so is all from an opening mark that is never closed."""
    opening, closing = parens
    out, depth, at = [], 0, 0
    for mark in re.finditer(f"[{re.escape(parens)}]", text):
        here = mark.start()
        if depth == 0:
            out += text[at:here].split()
            at = here
            if mark[0] == closing:
                if strict:
                    raise ValueError(f"Un-matched close paren at char {here}")
                out.append(closing)
                at = here + 1
                continue
        depth += 1 if mark[0] == opening else -1
        if depth == 0:
            out.append(text[at : here + 1])
            at = here + 1
    if depth and strict:
        raise ValueError(f"Un-matched open paren at char {at}")
    return out + ([text[at:]] if depth else text[at:].split())


def sexpr_tokenize(text: Column | str, parens: str = "()", strict: bool = True, on_error: str = "raise") -> Column:
    """``groups`` of a text column. With ``on_error`` null, unbalanced texts give null instead of an error."""
    if len(parens) != 2:
        raise ValueError("parens must be an opening and a closing character")

    def one(text: str) -> list[str] | None:
        try:
            return groups(text, parens, strict)
        except ValueError:
            if on_error == "raise":
                raise
            return None

    return arrow(STRINGS, one)(col(text))
