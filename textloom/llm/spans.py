"""Substring deduplication by sliding sentence spans.

A sentence ends with a word that ends in ``. ! ?`` (closing quotes and brackets
may follow) or at a line break. From every sentence on, the run of at least ``MIN_SENTENCES``
consecutive sentences that first holds ``min_words`` words is hashed over its A-Z lower-cased
words; a sentence of ``LONG`` words, a passage by itself, is a run alone. Runs are joined by hash over the whole corpus; wherever a run occurs again,
all but its first occurrence (smallest id, then place) are removed, sentence by sentence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import textkernel as tk
from textloom.llm.shared import bounded_batches, free_name, written

MIN_WORDS = 20
MIN_SENTENCES = 2
#: Words of a sentence that needs no neighbour.
LONG = 50
_ENDS, _CLOSES = np.zeros(256, bool), np.zeros(256, bool)
_ENDS[list(b".!?")] = True
_CLOSES[list(b"\"')]}")] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word starts, word ends, index of each document's first word, of each sentence's first word, of each document's first sentence)."""
    starts, ends, first = tk.words(data, offsets)
    if not len(starts):
        return starts, ends, first, np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    last = data[ends - 1]
    stop = _ENDS[last]
    closed = np.flatnonzero(_CLOSES[last] & (ends - starts > 1))
    back = ends[closed] - 2
    for _ in range(3):  # a mark may stand before up to three closers
        stop[closed[_ENDS[data[back]]]] = True
        go = _CLOSES[data[back]] & (back > starts[closed])
        closed, back = closed[go], back[go] - 1
    lines = np.flatnonzero(data == 10)
    breaks = np.searchsorted(lines, starts)
    opens = np.zeros(len(starts), bool)
    opens[0] = True
    opens[1:] = stop[:-1] | (breaks[1:] > breaks[:-1])
    opens[first[:-1][first[:-1] < first[1:]]] = True
    at = np.flatnonzero(opens)
    return starts, ends, first, at, np.searchsorted(at, first)


def run_hashes(data: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first sentence within it, sentences, hash) of every run of sentences."""
    low = tk.LOWER[data]
    starts, ends, first, at, own = sentences(low, offsets)
    hashes = tk.span_hashes(low, starts, ends)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(own))
    bounds = np.append(at, len(starts))
    stop = np.searchsorted(bounds, at + min_words, "left")
    several = np.arange(len(at)) + MIN_SENTENCES
    stop = np.where(np.diff(bounds) >= max(LONG, min_words), stop, np.maximum(stop, several))
    held = np.flatnonzero((stop < len(bounds)) & (stop <= own[1:][doc]))
    power, inverse = tk._power(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=total[1:])
    a, b = at[held], bounds[stop[held]]
    keys = tk.mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))
    return doc[held], held - own[:-1][doc[held]], stop[held] - held, keys


def _runs(min_words: int):
    """Rows (hash, key, place) of all runs; the hash is null where the document has had the run before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tk.buffers(batch.column(1))
            ids = batch.column(0).to_numpy()
            for lo, hi in tk.slices(offs):
                doc, place, _, keys = run_hashes(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], min_words)
                order = np.lexsort((place, keys, doc))
                again = np.zeros(len(order), bool)
                again[1:] = (keys[order][1:] == keys[order][:-1]) & (doc[order][1:] == doc[order][:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[order].view(np.int64), mask=again), pa.array(ids[lo:hi][doc[order]]), pa.array(place[order].astype(np.int32))], ["hash", "key", "place"]
                )

    return run


def _cut(min_words: int, at_text: int):
    """Column ``at_text`` without the sentences of the runs that start at the places in the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tk.buffers(batch.column(at_text))
            listed = batch.column(batch.num_columns - 1).fill_null([])
            for lo, hi in tk.slices(offs):
                raw, own_offs = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                starts, _, _, at, own = sentences(tk.LOWER[raw], own_offs)
                doc, place, length, _ = run_hashes(raw, own_offs, min_words)
                begin = np.searchsorted(doc, np.arange(hi - lo + 1))
                keep, removed = np.ones(len(raw), bool), np.zeros(hi - lo, np.int64)
                for k in np.flatnonzero(np.asarray(listed[lo:hi].value_lengths())).tolist():
                    mine = np.asarray(listed[lo + k].values)
                    runs_at = begin[k] + np.searchsorted(place[begin[k] : begin[k + 1]], mine)
                    change = np.zeros(own[k + 1] - own[k] + 1, np.int64)
                    np.add.at(change, mine, 1)
                    np.add.at(change, mine + length[runs_at], -1)
                    gone = np.cumsum(change[:-1]) > 0
                    removed[k] = gone.sum()
                    edges = np.append(starts[at[own[k] : own[k + 1]]], own_offs[k + 1])
                    flips = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    for first, last in zip(edges[flips[0::2]].tolist(), edges[flips[1::2]].tolist(), strict=True):
                        keep[first:last] = False
                ends = np.concatenate([[0], np.cumsum(keep)])[own_offs].astype(np.int64)
                text = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(ends), pa.py_buffer(raw[keep].tobytes())).cast(pa.string())
                nulls = batch.column(at_text)[lo:hi].is_null()
                columns = [c[lo:hi] for c in batch.columns[:-1]]
                columns[at_text] = pc.if_else(nulls, pa.scalar(None, pa.string()), text)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(own)), pa.array(removed)], [*batch.schema.names[:-1], "n_sentences", "n_removed"])

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """``docs`` with a long key of its own for each row behind its columns, and the name of the key, which no column has.

    Keys are in the order of ids (nulls last, then by text). Where ids are distinct they are the keys and nothing moves.
    """
    key = free_name(docs, "_key")
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    if ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").isEmpty():
        return docs.withColumn(key, F.col(id_col).cast("long")), key
    ordered = docs.orderBy(F.col(id_col).asc_nulls_last(), F.xxhash64(F.col(text_col)))
    return written(ordered.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut from ``text_col``, and columns n_sentences (before), n_removed.

    Columns of ``docs`` with these two names give way. Every row stays, also one of which nothing is left (an empty text). Null, blank
    and short texts (fewer than ``min_words`` words) are unchanged. Rows that share
    an id are documents of their own, in the order of their texts' hashes; of equal rows
    the later ones lose what the first one has. A table without rows gives none.
    """
    bounded_batches(docs.sparkSession)
    rows, key = keyed(docs, id_col, text_col)
    text = rows.select(F.col(key).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    runs = text.mapInArrow(_runs(min_words), "hash long, key long, place int")
    repeated = runs.where("hash is not null").groupBy("hash").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "first")
    later = runs.where("hash is not null").join(repeated, "hash").where("key <> first").select("key", "place").unionByName(runs.where("hash is null").select("key", "place"))
    listed = written(later.groupBy("key").agg(F.sort_array(F.collect_set("place")).alias("places")), "places")
    names = docs.columns
    plain = rows.toDF(*[f"c{k}" for k in range(len(names))], "key")
    whole = plain.join(listed, "key", "left").select(*[f"c{k}" for k in range(len(names))], "places")
    at_text = names.index(text_col)
    whole = whole.withColumn(f"c{at_text}", F.col(f"c{at_text}").cast("string"))
    schema = T.StructType([*whole.schema.fields[:-1], T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])
    out = whole.mapInArrow(_cut(min_words, at_text), schema)
    kept = [(k, n) for k, n in enumerate(names) if n not in ("n_sentences", "n_removed")]
    return out.select(*[F.col(f"c{k}").alias(n) for k, n in kept], "n_sentences", "n_removed")
