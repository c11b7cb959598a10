"""Language identification by a bidirectional gated recurrent network over bytes.

A forward and a backward gated recurrent layer read a text and a softmax labels every
byte's place. Texts are read in overlapping stretches: ``CORE`` bytes are labelled, and the
layers come to them from ``REACH`` bytes further out on either side, so no word is cut where
a stretch ends. A document's probabilities are the mean over the places of its letters. The
network is trained in numpy by backpropagation through time over stretches of ``CHUNK`` bytes,
led in alike, of the whole texts of at most ``per_label`` documents of each language, short and
long ones drawn alike; predicting reads every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import textkernel as tk
from textloom.llm.shared import bounded_batches, written

CHUNK, LEAD, HIDDEN, PER_LABEL, STEPS, RATE = 64, 16, 8, 1000, 500, 0.02
CORE, REACH = 256, 32
#: Scores held at once in predicting.
SCORES = 4_000_000
UNKNOWN = "und"
#: Labels and drawn rows are broadcast up to this number (some 40 MB), else joined by shuffle.
BROADCAST_ROWS = 1_000_000
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[0x80:] = True


@dataclass
class Network:
    """Weights of both layers side by side. Rows of ``table``, ``bias`` and ``inner`` are gates: update, reset, candidate, each forward then backward."""

    labels: list[str]
    table: np.ndarray  # [256, 6 hidden]: what a byte adds to the gates
    inner: np.ndarray  # [6 hidden, 2 hidden], each layer reading its own state only
    out: np.ndarray  # [labels, 2 hidden]
    bias: np.ndarray  # [labels, 1]

    @property
    def hidden(self) -> int:
        return self.inner.shape[1] // 2


def _mask(hidden: int) -> np.ndarray:
    """1 where a gate of a layer may read a state of the same layer."""
    side = np.tile(np.repeat([0, 1], hidden), 3)
    return (side[:, None] == np.repeat([0, 1], hidden)[None, :]).astype(np.float32)


def new_network(labels: list[str], hidden: int, rng: np.random.Generator) -> Network:
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Network(labels, draw(256, 6 * hidden, scale=0.3), draw(6 * hidden, 2 * hidden, scale=hidden**-0.5) * _mask(hidden), draw(len(labels), 2 * hidden, scale=0.3), np.zeros((len(labels), 1), np.float32))


def _gates(net: Network, chunks: np.ndarray, t: int) -> np.ndarray:
    """What the bytes at step ``t`` (from the front for one layer, from the back for the other) add: [6 hidden, chunks]."""
    h = net.hidden
    ahead, behind = net.table[chunks[t]], net.table[chunks[len(chunks) - 1 - t]]
    both = np.empty((len(net.inner), chunks.shape[1]), np.float32)
    for k in range(0, 6, 2):
        both[k * h : (k + 1) * h] = ahead[:, k * h : (k + 1) * h].T
        both[(k + 1) * h : (k + 2) * h] = behind[:, (k + 1) * h : (k + 2) * h].T
    return both


def _forward(net: Network, chunks: np.ndarray, keep: bool = False):
    """Scores [steps, labels, chunks] of bytes [steps, chunks]; with ``keep`` also what the way back needs."""
    steps, n = chunks.shape
    h2 = 2 * net.hidden
    state = np.zeros((h2, n), np.float32)
    front, back = net.out[:, : net.hidden], net.out[:, net.hidden :]
    scores = np.empty((steps, len(net.labels), n), np.float32)
    scores[:] = net.bias
    trace = []
    for t in range(steps):
        add = _gates(net, chunks, t)
        pull = net.inner @ state
        gates = add[: 2 * h2] + pull[: 2 * h2]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        update, reset = gates[:h2], gates[h2:]
        fresh = np.tanh(add[2 * h2 :] + reset * pull[2 * h2 :])
        if keep:
            trace.append((state, update, reset, fresh, pull[2 * h2 :]))
        state = fresh + update * (state - fresh)
        scores[t] += front @ state[: net.hidden]
        scores[steps - 1 - t] += back @ state[net.hidden :]
    return (scores, trace, state) if keep else scores


def gradients(net: Network, chunks: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over weighted places and its gradients, by backpropagation through time."""
    scores, trace, last = _forward(net, chunks, keep=True)
    steps, n = chunks.shape
    h, h2 = net.hidden, 2 * net.hidden
    scores -= scores.max(1, keepdims=True)
    p = np.exp(scores)
    p /= p.sum(1, keepdims=True)
    total = max(1.0, float(weight.sum()))
    loss = -float((np.log(np.maximum(p[:, target, np.arange(n)], 1e-12)) * weight).sum()) / total
    p[:, target, np.arange(n)] -= 1
    error = p * (weight / total)[:, None, :]
    front, back = net.out[:, :h], net.out[:, h:]
    d_out, d_bias = np.zeros_like(net.out), error.sum((0, 2))[:, None]
    d_inner, d_table, d_state = np.zeros_like(net.inner), np.zeros_like(net.table), np.zeros((h2, n), np.float32)
    states = [x[0] for x in trace] + [last]
    for t in range(steps - 1, -1, -1):
        before, update, reset, fresh, pulled = trace[t]
        after = states[t + 1]
        d_out[:, :h] += error[t] @ after[:h].T
        d_out[:, h:] += error[steps - 1 - t] @ after[h:].T
        d_state[:h] += front.T @ error[t]
        d_state[h:] += back.T @ error[steps - 1 - t]
        d_fresh = d_state * (1 - update) * (1 - fresh * fresh)
        d_update = d_state * (before - fresh) * update * (1 - update)
        d_reset = d_fresh * pulled * reset * (1 - reset)
        d_pull = np.concatenate([d_update, d_reset, d_fresh * reset])
        d_add = np.concatenate([d_update, d_reset, d_fresh])
        d_inner += d_pull @ before.T
        d_state = d_state * update + net.inner.T @ d_pull
        for side, at in ((0, t), (1, steps - 1 - t)):
            for k in range(3):
                rows = slice((2 * k + side) * h, (2 * k + side + 1) * h)
                np.add.at(d_table[:, rows], chunks[at], d_add[rows].T)
    return loss, [d_table, d_inner * _mask(h), d_out, d_bias]


def train(windows: np.ndarray, target: np.ndarray, labels: list[str], share: np.ndarray, hidden: int = HIDDEN, steps: int = STEPS, rate: float = RATE, batch: int = 256, seed: int = 5) -> Network:
    """A network fitted to byte windows [windows, CHUNK + 2 LEAD] by Adam; batches draw each label alike and its windows by ``share``."""
    rng = np.random.default_rng(seed)
    net = new_network(labels, hidden, rng)
    parts = [net.table, net.inner, net.out, net.bias]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    members = [np.flatnonzero(target == k) for k in range(len(labels))]
    running = [np.cumsum(share[m]) for m in members]
    core = ((np.arange(windows.shape[1]) >= LEAD) & (np.arange(windows.shape[1]) < LEAD + CHUNK))[:, None]
    for step in range(1, steps + 1):
        pick = np.concatenate([m[np.searchsorted(c[:-1], rng.random(max(1, batch // len(labels))) * c[-1], "right")] for m, c in zip(members, running, strict=True)])
        chunks = np.ascontiguousarray(windows[pick].T)
        _, grads = gradients(net, chunks, target[pick], (_LETTER[chunks] & core).astype(np.float32))
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, a, b in zip(parts, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


def chunked(low: np.ndarray, offsets: np.ndarray, size: int = CHUNK, reach: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(bytes [size + 2 reach, chunks], index of each document's first chunk).

    A chunk is ``size`` bytes of a document with ``reach`` more on either side; what lies outside the document is spaces.
    """
    counts = -(-np.diff(offsets) // size)
    first = np.concatenate([[0], np.cumsum(counts)])
    if not len(low):
        return np.zeros((size + 2 * reach, 0), np.uint8), first
    doc = np.repeat(np.arange(len(counts)), counts)
    start = offsets[:-1][doc] + size * (np.arange(first[-1]) - first[:-1][doc])
    at = start[None, :] + np.arange(-reach, size + reach)[:, None]
    inside = (at >= offsets[:-1][doc][None, :]) & (at < offsets[1:][doc][None, :])
    return np.where(inside, low[np.clip(at, 0, len(low) - 1)], 0x20).astype(np.uint8), first


def pooled(net: Network, low: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean label probabilities over the letters of each document: [documents, labels]; 0 without letters."""
    chunks, first = chunked(low, offsets, CORE, REACH)
    core = slice(REACH, REACH + CORE)
    width = min(2048, max(64, SCORES // (len(chunks) * len(net.labels))))
    sums, counts = np.zeros((len(net.labels), chunks.shape[1])), np.zeros(chunks.shape[1])
    for lo in range(0, chunks.shape[1], width):
        own = np.ascontiguousarray(chunks[:, lo : lo + width])
        p = _forward(net, own)[core]
        np.exp(np.minimum(p, 60, out=p), out=p)
        letter = _LETTER[own[core]]
        scale = letter / p.sum(1)
        sums[:, lo : lo + width] = np.einsum("tln,tn->ln", p, scale)
        counts[lo : lo + width] = letter.sum(0)
    running = np.concatenate([np.zeros((len(net.labels) + 1, 1)), np.cumsum(np.vstack([sums, counts[None]]), 1)], 1)
    per_doc = (running[:, first[1:]] - running[:, first[:-1]]).T
    return per_doc[:, :-1] / np.maximum(per_doc[:, -1:], 1)


def _has_letters(low: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents with an ASCII letter, or else any letter at all."""
    ascii_letters = np.concatenate([[0], np.cumsum((low >= 97) & (low < 123))])
    out = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
    for k in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[k] = any(c.isalpha() for c in low[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


def _predict(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tk.buffers(batch.column(1))
            for lo, hi in tk.slices(offs):
                low, own = tk.LOWER[data[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo]
                said, score = np.full(hi - lo, UNKNOWN, object), np.zeros(hi - lo)
                if net is not None:
                    p = pooled(net, low, own)
                    known = _has_letters(low, own)
                    best = p.argmax(1)
                    said[known] = np.array(net.labels, object)[best[known]]
                    score[known] = np.minimum(p[np.arange(len(p)), best], 1.0)[known]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(said.tolist(), pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of each text, with its label and one by their number."""
    for batch in batches:
        data, offs = tk.buffers(batch.column(1))
        for lo, hi in tk.slices(offs):
            windows, first = chunked(tk.LOWER[data[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo], CHUNK, LEAD)
            raw = np.ascontiguousarray(windows.T).tobytes()
            pieces = pa.Array.from_buffers(pa.binary(len(windows)), windows.shape[1], [None, pa.py_buffer(raw)]).cast(pa.binary())
            count = np.diff(first)
            text = np.repeat(np.arange(hi - lo), count)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(text)), pieces, pa.array(1.0 / count[text])], ["label", "piece", "share"])


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label: int = PER_LABEL, **options) -> Network | None:
    """A network trained on ``usable`` rows with a language: of each, the whole texts of ``per_label`` documents at most.

    None if there are none. The driver holds these texts in bytes: some 3 MB a language where texts have 2 kB. Documents are drawn by the hash of their id: those of the smallest hashes, of which a bound leaves
    ten standard deviations more than ``per_label`` to be ranked.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    marked = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("label"), F.xxhash64(id_col).alias("mark"))
    # the marks of a label are spread evenly: those below a bound are some more than are wanted, and few enough to rank
    share = (per_label + 10 * per_label**0.5 + 50) / F.col("n")
    counts = written(marked.groupBy("label").agg(F.count("*").alias("n")), "labels")
    few = marked.join(F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts, "label").where(F.col("mark") / F.lit(2.0**64) + 0.5 < share)
    order = Window.partitionBy("label").orderBy("mark", "id")
    drawn = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_label).select("id", "label")
    texts = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"))
    drawn = written(drawn, "drawn")
    small = drawn.count() <= BROADCAST_ROWS
    pieces = texts.join(F.broadcast(drawn) if small else drawn, ["id", "label"], "left_semi").select("label", "text").mapInArrow(_windows, "label string, piece binary, share double").toArrow()
    if not pieces.num_rows:
        return None
    rows = sorted(zip(*(pieces[c].to_pylist() for c in ("label", "piece", "share")), strict=True))
    names, pieces, shares = zip(*rows, strict=True)
    labels = sorted(set(names))
    windows = np.frombuffer(b"".join(pieces), np.uint8).reshape(len(pieces), -1)
    return train(windows, np.searchsorted(labels, names), labels, np.array(shares), **options)


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for each row of ``docs``, from its text alone.

    ``score`` is the pooled probability of the predicted label. A null text, one
    without letters, or any text for want of training rows is ``und`` with score 0.
    An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_predict(net), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)
