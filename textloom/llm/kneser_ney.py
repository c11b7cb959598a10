"""An interpolated modified Kneser-Ney model of words, of any order from two on.

Counting runs in Spark. Vocabulary and n-gram counts become sorted arrays cut into
shard files in the shared folder, written by the workers, and memory-mapped by the
workers that score. A word's id is its rank by frequency in its shard of the vocabulary, with the shard, so that frequent words
have small ids, which compress well; n-grams are counted as tuples of ids, so they never collide while counting. What is shuffled are sorted,
delta-coded and compressed blocks, one for each shard of each batch of texts: pairs are dealt by
a hash of the whole key, longer n-grams by their context, which has a row for each different
follower of a block at most, whatever its frequency.

Stored n-grams are found by a 64-bit hash, of which a shard's directory and 24 more bits are
kept: an n-gram that was never seen is taken for a seen one about once in 2^20 lookups. What occurs
once is stored as its hash alone.

``p(w|h) = max(a(hw) - D, 0) / a(h) + g(h) p(w|h')``, ``h'`` being ``h`` without its first word. ``a`` counts
occurrences at the highest order and different words before the n-gram below it; the lowest
order ends in the uniform ``1 / (V + 1)``. The three discounts of each level come from its counts
of counts. Every text ends with an end token and starts after start marks.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import textkernel as tk
from textloom.llm.shared import bounded_batches, new_path

ORDER = 3
BLOCK_BYTES = 4 << 20
SHARD_KEYS = 2_000_000
GATHER = 3_000_000
END = np.uint64(0x656E64206F66206C)


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder as Spark names it."""
    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3" + uri[3:]
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def save(uri: str, name: str, values: np.ndarray) -> None:
    """Write an array as a file of the shared folder; a task that runs twice leaves the same there."""
    store, root = _store(uri)
    store.create_dir(root, recursive=True)
    part, path = f"{root}/.{name}.{uuid.uuid4().hex}", f"{root}/{name}"
    with store.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(values))
    try:
        store.move(part, path)
    except OSError:  # a store whose rename does not replace
        if store.get_file_info(path).type != fs.FileType.File:
            raise
        store.delete_file(part)


_mapped: dict[tuple[str, str], np.ndarray] = {}
_fetched: list[str] = []


@atexit.register
def _forget() -> None:
    """Drop all maps and the files that were fetched for them."""
    _mapped.clear()
    while _fetched:
        os.unlink(_fetched.pop())


def mapped(uri: str, name: str, kind: type) -> np.ndarray:
    """The array, memory-mapped; empty where there is no such file. From a store that is no mounted folder the file is fetched first."""
    found = _mapped.get((uri, name))
    if found is None:
        if len(_mapped) > 4096:
            _forget()
        store, root = _store(uri)
        path = f"{root}/{name}"
        if store.get_file_info(path).type != fs.FileType.File:
            found = np.zeros(0, kind)
        else:
            if not isinstance(store, fs.LocalFileSystem):
                local = os.path.join(tempfile.gettempdir(), uuid.uuid4().hex)
                _fetched.append(local)
                fs.copy_files(path, local, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
                path = local
            found = np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
        _mapped[uri, name] = found
    return found


#: The columns of what occurs once: its count, or of a context the sum over its followers and those with counts of one, two, more.
_ONCE = (1, 1, 0, 0)


def _directory(keys: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
    """Sorted hashes as arrays: sizes, a directory by top bits, 16 and 8 bits more of each hash, each column as narrow as it can be."""
    bits = max(0, len(keys).bit_length() - 4)
    columns = [c.astype(np.min_scalar_type(int(c.max(initial=0)))) for c in columns]
    bounds = np.searchsorted(keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32)
    rest = keys << np.uint64(bits) >> np.uint64(40)
    return [np.array([len(keys), bits, *(c.itemsize for c in columns)], np.int64), bounds, (rest >> np.uint64(8)).astype(np.uint16), rest.astype(np.uint8), *columns]


def save_table(uri: str, name: str, keys: np.ndarray, columns: list[np.ndarray]) -> None:
    """Write hashes with columns of counts: those with the columns of ``_ONCE``, then the others with their columns."""
    order = np.argsort(keys, kind="stable")
    keys, columns = keys[order], [c[order] for c in columns]
    once = np.logical_and.reduce([c == x for c, x in zip(columns, _ONCE, strict=False)])
    parts = _directory(keys[once], []) + _directory(keys[~once], [c[~once] for c in columns])
    save(uri, name, np.concatenate([np.frombuffer(x.tobytes().ljust(-(-x.nbytes // 8) * 8, b"\0"), np.uint8) for x in parts]))


def _places(bounds: np.ndarray, high: np.ndarray, low: np.ndarray, bits: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which keys are in a directory, their places)."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    wanted = (keys << np.uint64(bits) >> np.uint64(40)).astype(np.uint32)
    first, end = bounds[bucket].astype(np.int64), bounds[bucket + 1].astype(np.int64)
    last, most = end.copy(), max(0, len(high) - 1)
    if not len(high):
        return first[:0], first[:0]
    value = lambda at: high[at].astype(np.uint32) << np.uint32(8) | low[at]
    for _ in range(int((end - first).max(initial=0)).bit_length()):
        mid = (first + last) >> 1
        less = (first < last) & (value(np.minimum(mid, most)) < wanted)
        first, last = np.where(less, mid + 1, first), np.where(less, last, mid)
    hit = np.flatnonzero((first < end) & (value(np.minimum(first, most)) == wanted))
    return hit, first[hit]


def table_counts(uri: str, name: str, keys: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` columns of a table for hashes: [width, keys], 0 where a hash is not there."""
    raw, out, at = mapped(uri, name, np.uint8), np.zeros((width, len(keys))), 0
    for columns in (0, width) if len(raw) else ():
        n, bits, *sizes = raw[at : at + 8 * (2 + columns)].view(np.int64).tolist()
        at, parts = at + 8 * (2 + columns), []
        for count, size in [((1 << bits) + 1, 4), (n, 2), (n, 1), *((n, x) for x in sizes)]:
            parts.append(raw[at : at + count * size].view(f"u{size}"))
            at += -(-count * size // 8) * 8
        hit, place = _places(*parts[:3], bits, keys)
        for k in range(width):
            out[k, hit] = parts[3 + k][place] if columns else _ONCE[k]
    return out


def packed(values: np.ndarray) -> bytes:
    """Rising 64-bit numbers as differences, byte plane by byte plane, compressed."""
    steps = np.diff(values, prepend=np.zeros(1, values.dtype)).astype(np.uint64)
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def small(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values, np.uint32).tobytes(), "zstd", asbytes=True)


def unsmall(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, 4 * n, "zstd", asbytes=True), np.uint32)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def streams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each document's words and end, index of each document's first token)."""
    low = tk.LOWER[data]
    starts, ends, first = tk.words(low, offsets)
    bounds = first + np.arange(len(first))
    out = np.full(bounds[-1], END)
    if len(starts):
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        out[np.arange(len(starts)) + doc] = tk.span_hashes(low, starts, ends)
    return out, bounds


def _bits(keys: int, per_shard: int) -> int:
    return max(0, (max(1, keys) // per_shard).bit_length())


def _gathered(batches: Iterator[pa.RecordBatch], keys_of) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sorted distinct keys, counts) of the texts of several batches, whenever ``GATHER`` keys are together."""
    held, size = [], 0
    for batch in batches:
        data, offs = tk.buffers(batch.column(0))
        for lo, hi in tk.slices(offs, BLOCK_BYTES):
            held.append(np.unique(keys_of(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]), return_counts=True))
            size += len(held[-1][0])
            if size > GATHER:
                yield summed(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
                held, size = [], 0
    if held:
        yield summed(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))


def _word_blocks(bits: int):
    """(shard, n, packed hashes, counts) of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _gathered(batches, lambda data, offs: streams(data, offs)[0]):
            yield _blocks(keys, counts, bits)

    return run


def _blocks(keys: np.ndarray, counts: np.ndarray, bits: int, shard: np.ndarray | None = None) -> pa.RecordBatch:
    """One row for each shard with keys: by ``shard``, or else by the keys' top bits. Keys rise."""
    if shard is None:
        shard = (keys >> np.uint64(63)) >> np.uint64(1) if bits == 0 else keys >> np.uint64(64 - bits)
    order = np.argsort(shard, kind="stable") if bits else slice(None)
    keys, counts, shard = keys[order], counts[order], shard[order]
    present, first = np.unique(shard, return_index=True)
    bounds = np.append(first, len(keys)).tolist()
    rows = [(int(s), b - a, packed(keys[a:b]), small(counts[a:b])) for s, a, b in zip(present.tolist(), bounds[:-1], bounds[1:], strict=True)]
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "n", "keys", "counts"])


BLOCKS = "shard int, n long, keys binary, counts binary"


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, keys, counts) of partitions sorted by shard, blocks summed up as they come."""
    now, held, size = None, [], 0
    for batch in batches:
        for shard, n, keys, counts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if shard != now:
                if held:
                    yield now, *summed(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
                now, held, size = shard, [], 0
            held.append((unpacked(keys, n), unsmall(counts, n).astype(np.int64)))
            size += n
            if len(held) > 1 and size > 4 * SHARD_KEYS:
                held = [summed(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))]
                size = len(held[0][0]) // 2
    if held:
        yield now, *summed(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))


def _keep_words(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, counts in _by_shard(batches):
            save(uri, f"words{shard}", keys)
            save(uri, f"counts{shard}", counts)
            ranks = np.empty(len(keys), np.uint32)
            ranks[np.argsort(-counts, kind="stable")] = np.arange(len(keys))
            save(uri, f"ranks{shard}", ranks)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(keys)]), pa.array([int(counts.sum())])], ["shard", "n", "total"])

    return run


@dataclass
class Words:
    """The sorted vocabulary, cut by top bits of the hash. Ids are below ``space``, which is the id of the start mark."""

    uri: str
    bits: int
    sizes: np.ndarray
    total: int

    @property
    def size(self) -> int:
        return int(self.sizes.sum())

    @property
    def space(self) -> int:
        return int(self.sizes.max()) << self.bits

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words; unknown ones have the id ``space + 1`` and count 0."""
        own, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(own), self.space + 1, np.int64), np.zeros(len(own), np.int64)
        edges = np.searchsorted(own, (np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)) if self.bits else np.zeros(0, np.uint64))
        for shard, (a, b) in enumerate(zip([0, *edges.tolist()], [*edges.tolist(), len(own)], strict=True)):
            if a < b and self.sizes[shard]:
                keys = mapped(self.uri, f"words{shard}", np.uint64)
                at = np.minimum(np.searchsorted(keys, own[a:b]), len(keys) - 1)
                hit = keys[at] == own[a:b]
                ids[a:b][hit] = mapped(self.uri, f"ranks{shard}", np.uint32)[at[hit]].astype(np.int64) << self.bits | shard
                counts[a:b][hit] = mapped(self.uri, f"counts{shard}", np.int64)[at[hit]]
        return ids[back], counts[back]


def grams(ids: np.ndarray, bounds: np.ndarray, n: int, start: int) -> np.ndarray:
    """[n, tokens]: each token's id in the last row, those of the tokens before it above."""
    out = np.empty((n, len(ids)), np.uint32)
    out[-1] = ids
    for k in range(n - 2, -1, -1):
        out[k, 1:] = out[k + 1, :-1]
        out[k, bounds[:-1]] = start
    return out


def hashed(rows: np.ndarray) -> np.ndarray:
    """64-bit hashes of the columns of ``rows``."""
    out = np.full(rows.shape[1], len(rows), np.uint64)
    for row in rows:
        out = tk.mix(out * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64) + np.uint64(1))
    return out


def _paired(rows: np.ndarray) -> np.ndarray:
    """Keys of the two ids of each column."""
    return rows[0].astype(np.uint64) << np.uint64(32) | rows[1].astype(np.uint64)


def distinct(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different columns of ``rows`` in order, with the sums of their counts."""
    if not rows.shape[1]:
        return rows, counts
    keys = [_paired(rows[k : k + 2]) if k + 1 < len(rows) else rows[k] for k in range(0, len(rows), 2)]
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = False
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return rows[:, order[first]], np.add.reduceat(counts[order], first)


def _gram_blocks(rows: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """One row for each shard of ordered n-grams: the ids' byte planes, the first id as differences, compressed."""
    shard = _shard_of(hashed(rows[:-1]), bits)
    order = np.argsort(shard, kind="stable")
    rows, counts = rows[:, order], counts[order]
    present, first = np.unique(shard[order], return_index=True)
    found = []
    for s, a, b in zip(present.tolist(), first.tolist(), [*first.tolist()[1:], len(order)], strict=True):
        part = rows[:, a:b].copy()
        part[0, 1:] -= rows[0, a : b - 1]
        planes = np.ascontiguousarray(part.view(np.uint8).reshape(len(part), b - a, 4).transpose(0, 2, 1))
        found.append((s, b - a, pa.compress(planes.tobytes(), "zstd", asbytes=True), small(counts[a:b])))
    columns = list(zip(*found, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "n", "keys", "counts"])


def _ids_of(raw: bytes, order: int, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * order * n, "zstd", asbytes=True), np.uint8).reshape(order, 4, n)
    rows = planes.transpose(0, 2, 1).copy().view(np.uint32).reshape(order, n)
    rows[0] = np.cumsum(rows[0], dtype=np.uint32)
    return rows


def _gram_shards(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, n-grams, counts) of partitions sorted by shard, blocks summed up as they come; shards below 0 as they are."""
    now, held, size = None, [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return distinct(np.concatenate([x[0] for x in held], axis=1), np.concatenate([x[1] for x in held]))

    for batch in batches:
        for shard, n, keys, counts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if shard != now:
                if held:
                    yield now, *merged()
                now, held, size = shard, [], 0
            rows = unpacked(keys, n).astype(np.uint32)[None] if shard < 0 else _ids_of(keys, order, n)
            held.append((rows, unsmall(counts, n).astype(np.int64)))
            size += n
            if len(held) > 1 and size > 4 * SHARD_KEYS:
                held = [merged()]
                size = held[0][0].shape[1] // 2
    if held:
        yield now, *merged()


def _tally(level: int, counts: np.ndarray) -> pa.RecordBatch:
    """A row of shard ``-level`` with the number of counts 1, 2, 3, 4 and more."""
    row = [-level, 5, packed(np.arange(5, dtype=np.uint64)), small(counts)]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "n", "keys", "counts"])


def _counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:6]


def _text_grams(words: Words, order: int, bits: int):
    """Blocks of the n-grams of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def together() -> pa.RecordBatch:
            return _gram_blocks(*distinct(np.concatenate([x[0] for x in held], axis=1), np.concatenate([x[1] for x in held])), bits)

        for batch in batches:
            data, offs = tk.buffers(batch.column(0))
            for lo, hi in tk.slices(offs, BLOCK_BYTES):
                hashes, bounds = streams(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                rows = grams(words.find(hashes)[0], bounds, order, words.space)
                held.append((rows, np.ones(rows.shape[1], np.int64)))
                size += rows.shape[1]
                if size > GATHER:
                    yield together()
                    held, size = [], 0
        if held:
            yield together()

    return run


def _keep_grams(uri: str, order: int, below: int):
    """Saves each shard's n-grams and contexts; blocks of the n-grams one shorter, with the number of different words before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows, counts in _gram_shards(batches, order):
            if shard < 0:
                yield _tally(-shard, counts)
                continue
            save_table(uri, f"grams{order}_{shard}", hashed(rows), [counts])
            context = rows[:-1]
            first = np.flatnonzero(np.concatenate([[True], (context[:, 1:] != context[:, :-1]).any(0)]))
            total = [np.add.reduceat(x.astype(np.int64), first) for x in (counts, counts == 1, counts == 2, counts > 2)]
            save_table(uri, f"contexts{order}_{shard}", hashed(context[:, first]), total)
            yield _tally(order, _counts_of_counts(counts))
            shorter, before = distinct(rows[1:], np.ones(rows.shape[1], np.int64))
            if order > 3:
                yield _gram_blocks(shorter, before, below)
            else:
                keys = _paired(shorter)
                yield _blocks(keys, before, below, _shard_of(keys, below))

    return run


def _shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (tk.mix(keys) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _pair_blocks(words: Words, bits: int):
    """(shard, n, packed pairs, counts) of each token with the one before it."""

    def pairs(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        hashes, bounds = streams(data, offs)
        return _paired(grams(words.find(hashes)[0], bounds, 2, words.space))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _gathered(batches, pairs):
            yield _blocks(keys, counts, bits, _shard_of(keys, bits))

    return run


def _keep_pairs(uri: str, id_bits: int):
    """Saves each shard; rows (shard of ids * 5 + kind, n, ids, counts): kinds 0 to 2 are the
    followers of a word with a count of one, two, more; 3 the words before it; 4 the sum over its followers. Shards below 0 have counts of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, counts in _by_shard(batches):
            if shard < 0:
                yield _tally(-shard, counts)
                continue
            save_table(uri, f"pairs{shard}", tk.mix(keys), [counts])
            left, right = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            for kind in range(5):
                own = right if kind == 3 else left if kind == 4 else left[counts == kind + 1] if kind < 2 else left[counts > 2]
                found, n = summed(own, counts if kind == 4 else np.ones(len(own), np.int64))
                part = _blocks(found.astype(np.uint64), n, 1, found >> id_bits)
                yield part.set_column(0, "shard", pa.array(np.asarray(part.column(0)) * 5 + kind, pa.int32()))
            yield _tally(2, _counts_of_counts(counts))

    return run


def _keep_ids(uri: str, id_bits: int):
    """Saves dense arrays of each kind for ranges of ids; rows (kind, tally of counts 1, 2, 3, 4, more), kinds below 0 being levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, counts in _by_shard(batches):
            tally = _counts_of_counts(counts) if shard >= 0 else counts
            kind, part = (shard, 0) if shard < 0 else (shard % 5, shard // 5)
            if shard >= 0:
                dense = np.zeros(1 << id_bits, np.min_scalar_type(int(counts.max())))
                dense[(keys & np.uint64((1 << id_bits) - 1)).astype(np.int64)] = counts
                save(uri, f"kind{kind}_{part}", dense)
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([tally.tolist()], pa.list_(pa.int64()))], ["kind", "tally"])

    return run


def discounts(tally: np.ndarray) -> np.ndarray:
    """D for counts of 0, 1, 2 and more, from the number of keys seen once to four times."""
    n1, n2, n3, n4 = (float(x) for x in tally[:4])
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    out = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5])
    return np.clip(out, [0, 0.05, 0.05, 0.05], [0, 1, 2, 3])


@dataclass
class Model:
    """``bits`` are those of the shards of each level, ``discounts`` those of the levels from words on."""

    words: Words
    uri: str
    order: int
    bits: int
    id_bits: int
    discounts: list[np.ndarray]
    pairs: int
    uniform: float
    spare: float

    def of_ids(self, kind: int, ids: np.ndarray) -> np.ndarray:
        """Counts of a kind for ids, 0 for unknown ones."""
        out = np.zeros(len(ids), np.float64)
        part = ids >> self.id_bits
        for k in np.unique(part).tolist():
            raw = mapped(self.uri, f"kind{kind}_{k}", np.uint8)
            if len(raw):
                own = np.flatnonzero(part == k)
                out[own] = raw.view(f"u{len(raw) >> self.id_bits}")[ids[own] & (1 << self.id_bits) - 1]
        return out

    def counts(self, name: str, keys: np.ndarray, dealt: np.ndarray, width: int) -> np.ndarray:
        """The columns of a table for keys, which ``dealt`` deals to shards; queries go through each shard in rising order."""
        own, first, back = np.unique(keys, return_index=True, return_inverse=True)
        out, shard = np.zeros((width, len(own))), _shard_of(dealt[first], self.bits)
        order = np.argsort(shard, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(own) else []:
            out[:, at] = table_counts(self.uri, f"{name}{shard[at[0]]}", own[at], width)
        return out[:, back]

    def log10(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 p of each token."""
        rows = grams(ids, bounds, self.order, self.words.space)

        def level(n: int, total: np.ndarray, seen: np.ndarray, followers: list[np.ndarray], lower: np.ndarray) -> np.ndarray:
            less = self.discounts[n - 1]
            share = np.where(total > 0, total, 1)
            direct = np.maximum(seen - less[np.minimum(seen, 3).astype(int)], 0) / share
            back = sum(less[k + 1] * followers[k] for k in range(3)) / share
            return np.where(total > 0, direct + back * lower, lower)

        n = self.of_ids(3, ids)
        p = np.maximum(n - self.discounts[0][np.minimum(n, 3).astype(int)], 0) / max(1, self.pairs) + self.spare * self.uniform
        before, pair = rows[-2].astype(np.int64), _paired(rows[-2:])
        p = level(2, self.of_ids(4, before), self.counts("pairs", tk.mix(pair), pair, 1)[0], [self.of_ids(k, before) for k in range(3)], p)
        for k in range(3, self.order + 1):
            context = hashed(rows[-k:-1])
            total, *followers = self.counts(f"contexts{k}_", context, context, 4)
            p = level(k, total, self.counts(f"grams{k}_", hashed(rows[-k:]), context, 1)[0], followers, p)
        return np.log10(p)


def fit(texts: DataFrame, text_col: str = "text", order: int = ORDER) -> Model:
    """Count every row of ``texts`` (null: empty) and store the model of n-grams up to ``order`` in the shared folder.

    What reaches the driver are the sizes of the shards and counts of counts.
    """
    if order < 2:
        raise ValueError("order must be 2 at least")
    bounded_batches(texts.sparkSession)
    spark = texts.sparkSession
    rows = texts.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    uri = new_path(spark, "model")
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()
    deal = lambda df, bits: df.repartition(1 << bits, "shard").sortWithinPartitions("shard")
    bits = min(16, _bits((size["bytes"] or 0) // 8, SHARD_KEYS))
    kept = deal(rows.mapInArrow(_word_blocks(bits), BLOCKS), bits).mapInArrow(_keep_words(uri), "shard int, n long, total long").collect()
    sizes = np.zeros(1 << bits, np.int64)
    for r in kept:
        sizes[r["shard"]] = r["n"]
    words = Words(uri, bits, sizes, sum(r["total"] for r in kept))
    if words.space >= (1 << 32) - 2:
        raise ValueError("some 2**32 different words: ids no longer fit an n-gram")
    bits = min(20, _bits(words.total, SHARD_KEYS))
    id_bits = max(16, words.space.bit_length() - min(12, max(0, words.space.bit_length() - 20)))
    blocks = rows.mapInArrow(_text_grams(words, order, bits) if order > 2 else _pair_blocks(words, bits), BLOCKS)
    for level in range(order, 2, -1):
        blocks = deal(blocks, bits).mapInArrow(_keep_grams(uri, level, bits), BLOCKS)
    by_id = deal(blocks, bits).mapInArrow(_keep_pairs(uri, id_bits), BLOCKS)
    kinds = deal(by_id, min(12, max(2, (words.space >> id_bits).bit_length() + 2))).mapInArrow(_keep_ids(uri, id_bits), "kind int, tally array<long>")
    tallies = {k: np.zeros(5, np.int64) for k in (*range(-order, -1), 3)}
    for r in kinds.groupBy("kind").agg(*(F.sum(F.col("tally")[k]).alias(f"n{k}") for k in range(5))).collect():
        tallies[r["kind"]] = np.array(r[1:], np.int64)
    total = int(tallies[-2].sum())
    lower = discounts(tallies[3])
    kinds_of = np.array([tallies[3][0], tallies[3][1], tallies[3][2:].sum()], float)
    spare = float((lower[1:] * kinds_of).sum()) / total if total else 1.0
    return Model(words, uri, order, bits, id_bits, [lower, *(discounts(tallies[-k]) for k in range(2, order + 1))], total, 1 / (words.size + 1), spare)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = model.words.total, model.words.size
        for batch in batches:
            data, offs = tk.buffers(batch.column(1))
            for lo, hi in tk.slices(offs, BLOCK_BYTES):
                hashes, bounds = streams(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                ids, counts = model.words.find(hashes)
                base = np.add.reduceat(np.log10((counts + 1) / (n + v + 1)), bounds[:-1])
                score = np.add.reduceat(model.log10(ids, bounds), bounds[:-1])
                known = np.add.reduceat((counts > 0).astype(np.int64), bounds[:-1])
                size = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(size), pa.array(known), pa.array(np.full(hi - lo, n)), pa.array(base), pa.array(score), pa.array(10 ** np.minimum(-score / size, 300))],
                    ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    return run


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score, perplexity) for each row of ``docs``.

    Scores are log10 probabilities of whole texts; ``base_score`` is that of add-one word
    frequencies. Null and blank texts are the end token alone. After words that the
    training texts never have together, the lower level is used alone. No rows give none.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_score(model), "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double").withColumnRenamed("id", id_col)
