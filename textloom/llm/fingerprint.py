"""Document fingerprints from closed syncmers.

A ``k``-byte window is an anchor if its smallest ``s``-byte substring, by hash,
starts at its first or last place. Whether it is depends on the window alone, so
unchanged passages keep their anchors whatever stands around them. A fingerprint
lists all anchors in text order as ``hash:position`` in hexadecimal, however long the text is.
Likenesses match anchors by position: those of equal hash that follow one another in the
same order in both texts.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import textkernel as tk
from textloom.llm.shared import bounded_batches, written

K, S = 12, 4
#: Rows are scanned in groups of so many bytes of text; a longer text stands alone.
GROUP_BYTES = 1 << 19
#: Parts of rows in id order, at most; the driver holds one bound and one link of each.
PARTS = 65_536
_HEX = np.frombuffer(b"".join(b"%02x" % k for k in range(256)), np.uint8).reshape(256, 2)
Anchors = tuple[np.ndarray, np.ndarray]


def anchors_of(texts: list[bytes], k: int = K, s: int = S) -> list[Anchors]:
    """(32-bit hashes, byte positions) of the closed syncmers of each text, in text order, from one pass over all.

    Each text is led by ``k - 1`` marks, so that even a short one has windows; an empty one has none.
    """
    lead, width = k - 1, k - s + 1
    mark = b"\x02" * lead
    data = np.frombuffer(b"".join(part for t in texts for part in (mark, t)), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([lead + len(t) for t in texts], dtype=np.int64)])
    n = len(data) - s + 1
    if n < width:
        return [(np.zeros(0, np.uint32), np.zeros(0, np.int64)) for _ in texts]
    small = np.zeros(n, np.uint64)
    for j in range(s):
        small = (small << np.uint64(8)) | data[j : j + n]
    small *= np.uint64(0x9E3779B97F4A7C15)
    small ^= small >> np.uint64(29)
    small *= np.uint64(0xBF58476D1CE4E5B9)
    least = tk.window_min(small, width)
    at = np.flatnonzero((small[: len(least)] == least) | (small[width - 1 :] == least))
    text = np.searchsorted(bounds, at, "right") - 1
    whole = at + k <= bounds[text + 1]
    at, text = at[whole], text[whole]
    places = np.maximum(at - bounds[text] - lead, 0)
    hashes = np.zeros(len(at), np.uint64)
    for j in range(0, width, s):
        hashes = (hashes ^ small[at + j]) * np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(32)
    if (width - 1) % s:
        hashes = (hashes ^ small[at + width - 1]) * np.uint64(0xD6E8FEB86659FD93)
    hashes = (hashes >> np.uint64(32)).astype(np.uint32)
    cuts = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
    return [(hashes[a:b], places[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def anchors(text: bytes, k: int = K, s: int = S) -> Anchors:
    """The closed syncmers of one text."""
    return anchors_of([text], k, s)[0]


def _digits(values: np.ndarray) -> np.ndarray:
    """Eight hexadecimal digits of each 32-bit number, as bytes."""
    return _HEX[values.astype(">u4").view(np.uint8)].reshape(len(values), 8)


def rendered(found: list[Anchors]) -> list[str]:
    """The fingerprint of each text."""
    if not found:
        return []
    hashes, places = (np.concatenate(part) for part in zip(*found, strict=True))
    out = np.empty((len(hashes), 18), np.uint8)
    out[:, :8], out[:, 8], out[:, 9:17], out[:, 17] = _digits(hashes), 58, _digits(places), 32
    keep = np.ones(out.shape, bool)
    keep[:, 9:16] = np.logical_or.accumulate(out[:, 9:16] != 48, axis=1)
    ends = np.concatenate([[0], np.cumsum(keep.sum(1))])[np.cumsum([0, *(len(f[0]) for f in found)])].tolist()
    line = out[keep].tobytes().decode("ascii")
    return [line[a : b - 1] if b > a else "" for a, b in zip(ends[:-1], ends[1:], strict=True)]


def render(hashes: np.ndarray, places: np.ndarray) -> str:
    return rendered([(hashes, places)])[0]


def _numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes numbered by occurrence, index of each), sorted: the second of two equal hashes differs from the first."""
    order = np.argsort(hashes, kind="stable")
    own = hashes[order]
    new = np.ones(len(own), bool)
    np.not_equal(own[1:], own[:-1], out=new[1:])
    place = np.arange(len(own))
    return own.astype(np.uint64) << np.uint64(32) | (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64), order


def matched(x: np.ndarray, y: np.ndarray) -> int:
    """The most anchors, of texts with hashes ``x`` and ``y`` in text order, that match in the same order in both.

    The i-th occurrence of a hash in one text matches the i-th in the other; the longest
    rising run of matched places is found in n log n steps.
    """
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    same = int(differ[0]) if len(differ) else n
    if same == n:
        return same
    (a, in_x), (b, in_y) = _numbered(x[same:]), _numbered(y[same:])
    _, at_x, at_y = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    along = in_y[at_y][np.argsort(in_x[at_x])]
    ends: list[int] = []
    for place in along.tolist():
        if not ends or place > ends[-1]:
            ends.append(place)
        else:
            ends[bisect_left(ends, place)] = place
    return same + len(ends)


def likeness(a: Anchors, b: Anchors) -> float:
    """Share of anchors that match in order (Dice over both texts); 1 for two texts without anchors."""
    total = len(a[0]) + len(b[0])
    return 2 * matched(a[0], b[0]) / total if total else 1.0


def edited(text: str, n: int, following: str) -> str:
    """``text`` with its last ``floor(n / 2)`` code points replaced by the first as many of ``following``."""
    half = n // 2
    return text[: n - half] + following[:half]


def _scan(k: int, s: int):
    """Fingerprints of rows sorted by (part, order); a row's successor is the next row of its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            _, offs = tk.buffers(batch.column(2))
            parts, ids, texts, closing = (c.to_pylist() for c in batch.columns)
            for lo, hi in tk.slices(offs, GROUP_BYTES):
                own = anchors_of([t.encode() for t in texts[lo:hi]], k, s)
                now = list(zip(parts[lo:hi], ids[lo:hi], texts[lo:hi], closing[lo:hi], own, strict=True))
                line = now if held is None else [held, *now]
                held = now[-1]
                pairs = [(x, y) for x, y in zip(line[:-1], line[1:], strict=True) if x[0] == y[0] and not x[3]]
                if not pairs:
                    continue
                raw = [edited(x[2], len(x[2]), y[2]).encode() for x, y in pairs]
                others = anchors_of(raw, k, s)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[1] for x, _ in pairs], pa.int64()),
                        pa.array([len(x[2]) for x, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(r).hexdigest() for r in raw]),
                        pa.array(rendered([x[4] for x, _ in pairs])),
                        pa.array(rendered(others)),
                        pa.array([likeness(x[4], o) for (x, _), o in zip(pairs, others, strict=True)], pa.float64()),
                        pa.array([likeness(x[4], y[4]) for x, y in pairs], pa.float64()),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return run


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S, part_rows: int = 2000) -> DataFrame:
    """Fingerprints of every text and of its edited text, one row for each row of ``docs``.

    The next document is that of the next smaller id (null last; rows of one id by
    text); after the last comes the first. Null texts count as empty; an empty text
    has an empty fingerprint. The rows are cut into parts by id bounds, and the first
    row of each part also closes the part before it, so no part waits for another. An
    empty table gives no rows. Columns: doc_id, n_chars (code points), edited_sha256,
    fingerprint, edited_fingerprint, near_edited and near_next (0 to 1).
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.count()
    parts = max(1, min(PARTS, total // part_rows))
    bounds = [] if total == 0 else rows.agg(F.percentile_approx("id", [j / parts for j in range(1, parts)] or [0.5], min(100 * parts, 1_000_000)).alias("b")).first()["b"] or []
    cuts = np.unique(np.array(bounds, np.int64)) if parts > 1 else np.zeros(0, np.int64)

    @F.arrow_udf("int")
    def part_of(ids: pa.Array) -> pa.Array:
        """0 for ids above the last bound, and so on down; null ids come after all."""
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        where = len(cuts) - np.searchsorted(cuts, ids.fill_null(0).to_numpy(), "left")
        return pa.array(np.where(known, where, len(cuts) + 1).astype(np.int32))

    ids = rows.select("id").withColumn("part", part_of("id"))
    heads = written(ids.groupBy("part").agg(F.max("id").alias("id")), "heads")
    present = [r["part"] for r in heads.select("part").orderBy("part").collect()]
    if not present:
        return spark.createDataFrame([], SCHEMA)
    before = dict(zip(present, [present[-1], *present[:-1]], strict=True))
    link = spark.createDataFrame([(p, q) for p, q in before.items()], "part int, previous int")
    closing = rows.join(F.broadcast(heads.join(link, "part").select(F.col("id").alias("head"), "previous")), F.col("id").eqNullSafe(F.col("head")))
    closing = closing.groupBy("previous").agg(F.min_by("text", "text").alias("text"), F.first("id").alias("id")).select(F.col("previous").alias("part"), "id", "text", F.lit(True).alias("closing"))
    placed = rows.withColumn("part", part_of("id")).select("part", "id", "text", F.lit(False).alias("closing")).unionByName(closing)
    dealt = placed.repartition(max(spark.sparkContext.defaultParallelism, len(present)), "part").sortWithinPartitions(F.col("part"), F.col("closing"), F.col("id").desc_nulls_last(), F.col("text"))
    return dealt.select("part", "id", "text", "closing").mapInArrow(_scan(k, s), SCHEMA)
