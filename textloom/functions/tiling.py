"""Segments of a text by topic: paragraphs, or valleys of lexical cohesion."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column

from textloom.functions.rx import STRINGS, arrow, col

#: Fixed value: how many of the deepest valleys may become cuts.
MOST_CUTS = 5


def similarities(tokens: list[str], w: int) -> np.ndarray:
    """Cosine in single precision of the ``w`` tokens before and after each gap from ``w`` on; sums slide along."""
    left, right = Counter(tokens[:w]), Counter(tokens[w : 2 * w])
    dot = sum(n * right[t] for t, n in left.items())
    a, b = sum(n * n for n in left.values()), sum(n * n for n in right.values())
    dots, lefts, rights = [dot], [a], [b]
    for gap in range(w + 1, len(tokens) - w):
        leaves, crosses, enters = tokens[gap - w - 1], tokens[gap - 1], tokens[gap + w - 1]
        dot -= right[leaves]
        a += 1 - 2 * left[leaves]
        left[leaves] -= 1
        dot -= left[crosses]
        b += 1 - 2 * right[crosses]
        right[crosses] -= 1
        dot += right[crosses]
        a += 1 + 2 * left[crosses]
        left[crosses] += 1
        dot += left[enters]
        b += 1 + 2 * right[enters]
        right[enters] += 1
        dots.append(dot)
        lefts.append(a)
        rights.append(b)
    f = np.float32
    return f(dots) / (np.sqrt(f(lefts)) * np.sqrt(f(rights)))


def segments(text: str, w: int = 20) -> list[str]:
    """Paragraphs between empty lines if there are several; else pieces between the deepest valleys, at least half of ``w`` apart."""
    if not text.strip():
        return []
    paragraphs = [p.strip() for p in text.split("\n\n") if p.strip()]
    if len(paragraphs) > 1:
        return paragraphs
    tokens = text.split()
    if len(tokens) <= 2 * w:
        return [text.strip()]
    sims = similarities(tokens, w)
    mean = np.add.accumulate(sims, dtype=np.float32)[-1] / np.float32(len(sims))
    if len(sims) < 3:
        return [text.strip()]
    before, after = np.maximum.accumulate(sims)[:-2], np.maximum.accumulate(sims[::-1])[::-1][2:]
    inner = sims[1:-1]
    depth = (before - inner) + (after - inner)
    valleys = np.flatnonzero((depth > 0) & (inner < mean))
    deepest = valleys[np.argsort(-depth[valleys], kind="stable")][:MOST_CUTS]
    cuts: list[int] = []
    for cut in sorted((deepest + 1 + w).tolist()):
        if not cuts or cut - cuts[-1] >= w // 2:
            cuts.append(cut)
    if not cuts:
        return [text.strip()]
    return [" ".join(tokens[a:b]) for a, b in zip([0, *cuts], [*cuts, len(tokens)], strict=True)]


def texttiling_tokenize(text: Column | str, w: int = 20, k: int = 10) -> Column:
    """``segments`` of a text column; ``k`` is accepted and has no effect."""
    del k

    return arrow(STRINGS, lambda t: segments(t, w))(col(text))
