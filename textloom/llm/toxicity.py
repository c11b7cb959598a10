"""Toxic passages by maximum-scoring segments.

Tokens are words, runs of letters without A-Z case. A word's features are the word and
its first 4, 5 and 6 bytes, since insults inflect and compound. A feature has the log-odds
between toxic and clean training documents, each counted once, under an informative
Dirichlet prior (spread as the features of both classes together), or none where they are within ``SURE``
standard deviations. A word scores as its feature of the largest odds either way, less a small
cost, so that ordinary text drifts downwards. A word repeated at once only costs. One linear scan of a document finds its best segment; where that is significant, all
maximal scoring segments are listed. Significance follows extreme-value theory: over
``n`` clean words a score of at least S is expected ``K n exp(-L S)`` times. L solves
``E[exp(L s)] = 1`` over clean words, K is fitted to the clean training documents, and a
logistic curve over ``-ln(K n exp(-L S))`` gives the probability of the label.

Fitting reads at most ``max_docs`` labelled documents, those of the smallest id
hashes; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import textkernel as tk
from textloom.llm.shared import bounded_batches, written

MAX_DOCS, PRIOR, SURE, COST, LEAST = 20_000, 0.05, 2.5, 0.7, 0.05
_SIEVE = 22
_LEADS = (4, 5, 6)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[0x80:] = True


@dataclass
class Model:
    """Sorted feature hashes with their odds; words without any of them score ``-cost``."""

    keys: np.ndarray
    odds: np.ndarray
    cost: float = COST
    rate: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def __post_init__(self) -> None:
        self.sieve = np.zeros(1 << _SIEVE, bool)
        self.sieve[(self.keys >> np.uint64(64 - _SIEVE)).astype(np.int64)] = True

    def of(self, features: np.ndarray) -> np.ndarray:
        """Scores of words from their features [kinds, words]."""
        odds = np.zeros(features.shape[1])
        for own in features:
            maybe = np.flatnonzero(self.sieve[(own >> np.uint64(64 - _SIEVE)).astype(np.int64)])
            if len(maybe):
                at = np.minimum(np.searchsorted(self.keys, own[maybe]), len(self.keys) - 1)
                hit = self.keys[at] == own[maybe]
                found, where = self.odds[at[hit]], maybe[hit]
                odds[where] = np.where(np.abs(found) > np.abs(odds[where]), found, odds[where])
        return odds - self.cost

    def evidence(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """``-ln`` of the expected number of segments as good in ``n`` clean words, short texts counting as those that expect one of sum 0."""
        return self.rate * best - np.maximum(0.0, self.log_k + np.log(np.maximum(n, 1)))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -30, 30)))


def best_segments(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The largest segment sum of each document, 0 at least; one pass over all of them.

    Documents are set apart by falling levels, so that the running minimum starts afresh.
    """
    n = len(first) - 1
    out = np.zeros(n)
    if not len(scores):
        return out
    total = np.concatenate([[0.0], np.cumsum(scores)])
    level = np.ceil(4 * float(np.abs(total).max())) + 1
    doc = np.repeat(np.arange(n), np.diff(first))
    before = total[:-1] - level * doc
    rise = total[1:] - level * doc - np.minimum.accumulate(before)
    held = np.flatnonzero(np.diff(first))
    out[held] = np.maximum(np.maximum.reduceat(rise, first[held]), 0.0)
    return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum) of one document, by a linear scan.

    Each candidate keeps the total before it and after it. A new positive word joins
    back over candidates whose left totals are not below its own as long as that raises the sum.
    """
    total, found = 0.0, []
    for k, s in enumerate(scores.tolist()):
        if s > 0:
            start, left, right = k, total, total + s
            while True:
                j = len(found) - 1
                while j >= 0 and found[j][1] >= left:
                    j = found[j][4]
                if j < 0 or found[j][2] >= right:
                    found.append((start, left, right, k + 1, j))
                    break
                start, left = found[j][0], found[j][1]
                del found[j:]
        total += s
    return [(a, end, right - left) for a, left, right, end, _ in found]


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features [kinds, words], index of each document's first word, whether a word is not that before it in its document)."""
    low = tk.LOWER[data]
    starts, ends, first = tk.runs(low, offsets, _LETTER[low])
    features = [tk.span_hashes(low, starts, ends)]
    for n in _LEADS:
        lead = tk.span_hashes(low, starts, np.minimum(starts + n, ends))
        features.append(np.where(ends - starts > n, tk.mix(lead + np.uint64(n)), features[0]))
    fresh = np.ones(len(starts), bool)
    fresh[1:] = features[0][1:] != features[0][:-1]
    fresh[first[:-1][first[:-1] < first[1:]]] = True
    return np.stack(features), first, fresh


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, toxic texts with it, clean ones) of the features of each batch of (text, label)."""
    for batch in batches:
        data, offs = tk.buffers(batch.column(0))
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, hi in tk.slices(offs):
            features, first, _ = letter_words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            doc = np.tile(np.repeat(np.arange(hi - lo), np.diff(first)), len(features))
            hashes = features.ravel()
            order = np.lexsort((doc, hashes))
            hashes, doc = hashes[order], doc[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
            keys, where = np.unique(hashes[new], return_inverse=True)
            hits = np.bincount(where, label[lo:hi][doc[new]], len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(hits), pa.array(np.bincount(where, minlength=len(keys)) - hits)], ["key", "toxic", "clean"])


def _scan(model: Model, spans: bool):
    """(n_words, best, evidence, segments) behind the other columns of each batch; the text is the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tk.buffers(batch.column(batch.num_columns - 1))
            for lo, hi in tk.slices(offs):
                features, first, fresh = letter_words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                scores = np.where(fresh, model.of(features), -model.cost)
                n, best = np.diff(first), best_segments(scores, first)
                evidence = model.evidence(best, n)
                columns = [pa.array(n), pa.array(best), pa.array(evidence)]
                if spans:
                    found: list[list] = [[] for _ in range(hi - lo)]
                    for k in np.flatnonzero(evidence > -np.log(LEAST)).tolist():
                        own = maximal_segments(scores[first[k] : first[k + 1]])
                        least = (-np.log(LEAST) + max(0.0, model.log_k + np.log(max(1, n[k])))) / model.rate
                        found[k] = [{"start": a, "end": b, "score": s} for a, b, s in own if s >= least]
                    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
                    columns += [pa.array(model.probability(evidence)), pa.array(found, kind)]
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in batch.columns[:-1]), *columns], [*batch.schema.names[:-1], "n_words", "best", "evidence", *(["score", "segments"] if spans else [])])

    return run


def _spread(model: Model):
    """(score, words) of the words of clean texts, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tk.buffers(batch.column(0))
            for lo, hi in tk.slices(offs):
                features, _, fresh = letter_words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                scores, n = np.unique(np.where(fresh, model.of(features), -model.cost), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(scores), pa.array(n)], ["score", "n"])

    return run


def feature_odds(toxic: np.ndarray, clean: np.ndarray, prior: float, totals: tuple[float, float]) -> np.ndarray:
    """Log-odds under a Dirichlet prior of ``prior`` times the counts of both classes, 0 within ``SURE`` standard deviations.

    ``totals`` are the counts of all features in each class.
    """
    alpha = prior * (toxic + clean)
    t, c = toxic + alpha, clean + alpha
    spare = prior * sum(totals)
    odds = np.log(t / max(1e-9, totals[0] + spare)) - np.log(c / max(1e-9, totals[1] + spare))
    spread = np.sqrt(1 / t + 1 / c)
    # multiples of 2**-12: sums of them are exact, in whatever order texts are read
    return np.round(np.where(np.abs(odds) > SURE * spread, odds, 0.0) * 4096) / 4096


def _told(prior: float, totals: tuple[float, float]):
    """(key, odds) of the features whose odds are not 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = feature_odds(*(batch.column(k).to_numpy().astype(float) for k in (1, 2)), prior, totals)
            held = np.flatnonzero(odds)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(held)), pa.array(odds[held])], ["key", "odds"])

    return run


def _positive_root(scores: np.ndarray, weights: np.ndarray) -> float:
    """L > 0 with ``E[exp(L s)] = 1``, by bisection; the mean must be negative."""
    weights = weights / weights.sum()
    low, high = 1e-6, 1.0
    value = lambda x: float((weights * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    if scores.max() <= 0:
        return 1.0
    while value(high) < 0 and high < 1e3:
        low, high = high, 2 * high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a ridge logistic curve, by Newton steps."""
    w = np.zeros(2)
    design = np.stack([x / 10, np.ones(len(x))], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (y - p) - 1e-2 * w
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        step *= min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return max(0.0, float(w[0]) / 10), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_DOCS, prior: float = PRIOR, cost: float = COST) -> Model:
    """A model from documents with a label, ``usable`` (over the label's id) and at most ``max_docs`` of them.

    An id with several labels counts as toxic if one says so. Without labels of both
    kinds every text scores the share of toxic ones (0 without labels).
    """
    bounded_batches(docs.sparkSession)
    known = labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "id").select("text", "label")
    texts = written(texts, "sample")
    counted = written(texts.mapInArrow(_counts, "key long, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "features")
    totals = tuple(float(x or 0) for x in counted.agg(F.sum("toxic"), F.sum("clean")).first())
    # only features that tell the classes apart leave the workers
    told = counted.mapInArrow(_told(prior, totals), "key long, odds double").toArrow().sort_by("key")
    keys, odds, cost = told["key"].to_numpy().view(np.uint64), told["odds"].to_numpy(), round(cost * 4096) / 4096
    order = np.argsort(keys)
    model = Model(keys[order], odds[order], cost)
    spread = texts.where("label = 0").select("text").mapInArrow(_spread(model), "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).toArrow()
    if spread.num_rows:
        model.rate = _positive_root(spread["score"].to_numpy(), spread["n"].to_numpy().astype(float))
    seen = texts.select("label", "text").mapInArrow(_scan(model, False), "label int, n_words long, best double, evidence double").select("label", "n_words", "best").toArrow()
    y, n, best = (seen[c].to_numpy().astype(float) for c in ("label", "n_words", "best"))
    if len(y) and (y == 0).any():
        base = model.rate * best[y == 0] - np.log(np.maximum(n[y == 0], 1))
        model.log_k = float(np.median(base)) + np.log(np.log(2))
    share = float(y.mean()) if len(y) else 0.0
    if 0 < share < 1:
        model.slope, model.offset = _logistic(model.evidence(best, n), y)
    else:
        model.slope, model.offset = 0.0, 30.0 if share else -30.0
    return model


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, n_words, best, evidence, segments) for each row of ``docs``.

    ``score`` is the probability of the label, ``segments`` the significant maximal
    segments as word ranges [start, end) with their sums. Null and blank texts have no
    words and score as a text without any evidence. Only the text is read. No rows give none.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = rows.mapInArrow(_scan(model, True), "id long, n_words long, best double, evidence double, score double, segments array<struct<start:int,end:int,score:double>>")
    return out.withColumnRenamed("id", id_col)
