"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file. The normaliser rewrites characters
(space marks, the leading mark, outer and repeated spaces). The lexicon is a tree of arcs, one for each
character, that gives a piece at its final states; a character that is no piece goes through the
byte fallback instead. The third machine weighs each pair of
neighbouring pieces: in a unigram model the piece's negative score; in a merge model
(BPE) zero if merging the two pieces' characters by the model's ranks gives just
these two, otherwise infinity. A sequence all of whose neighbours pass is
the one that merging the whole text gives: were it not, the first merge across one of
its borders would also happen in the two pieces alone. Encoding composes the
machines with the input, lazily, and takes the shortest path in the tropical semiring
(minimum, plus). States are (place, state of the lexicon, last piece).

No piece may hold a space mark after another character, so words compose
on their own, and each worker keeps the paths of the words it has seen over
all its tasks, up to ``CACHE_BYTES`` of them, and up to ``PAIRS`` weights of pairs.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import bounded_batches

MARK, CACHE_BYTES, PAIRS = "▁", 256 << 20, 2_000_000
NORMAL, UNKNOWN, CONTROL, DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces in a model file
INF = float("inf")


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            n, at = varint(at)
            value, at = raw[at : at + n], at + n
        elif key & 7 == 5:
            value, at = struct.unpack_from("<f", raw, at)[0], at + 4
        else:
            value, at = raw[at : at + 8], at + 8
        yield key >> 3, value


class Paths(dict):
    """Packed ids of words, found when first asked for; all are forgotten once they take ``CACHE_BYTES``."""

    def __init__(self, path) -> None:
        super().__init__()
        self.path, self.held = path, 0

    def __missing__(self, word: str) -> bytes:
        found = array("i", self.path(word.replace(" ", MARK))).tobytes()
        size = 200 + 4 * len(word) + len(found)
        if self.held + size > CACHE_BYTES:
            self.clear()
            self.held = 0
        if size <= CACHE_BYTES:
            self[word] = found
            self.held += size
        return found


@dataclass
class Normaliser:
    """The machine in front: an arc that writes ``lead`` before the first character, arcs that
    rewrite single characters, and with ``squeeze`` a state that passes one space of a run inside the text and none outside.
    All other arcs copy their character, so whole runs of them go through at once."""

    lead: str
    arcs: dict[int, str]
    squeeze: bool

    def __call__(self, text: str) -> str:
        text = text.translate(self.arcs)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return self.lead + text if text else text


@dataclass
class Transducer:
    """A compiled model; ``ids`` has the pieces that text can match."""

    names: list[str]
    kinds: list[int]
    scores: list[float]
    merges: bool
    dummy_prefix: bool = True
    trim: bool = False
    ids: dict = field(default_factory=dict)
    pairs: dict = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.ids = {n: k for k, (n, kind) in enumerate(zip(self.names, self.kinds, strict=True)) if kind in (NORMAL, DEFINED)}
        self.normalised = Normaliser(" " if self.dummy_prefix else "", {ord(MARK): " "}, self.trim)
        # the lexicon: a state's arcs by character, and under "" its piece, if it has one
        self.root: dict = {}
        for name, piece in self.ids.items():
            node = self.root
            for ch in name:
                node = node.setdefault(ch, {})
            node[""] = piece
        self.known_pairs, self.words = 0, Paths(self.path)
        self.fallback = 1.0 if self.merges else 10.0 - min(self.scores, default=0.0)
        self.key = hashlib.md5(repr((self.names, self.scores)).encode()).hexdigest()
        self.bytes_ = {int(n[3:5], 16): k for k, (n, kind) in enumerate(zip(self.names, self.kinds, strict=True)) if kind == BYTE}
        self.unknown = next((k for k, kind in enumerate(self.kinds) if kind == UNKNOWN), None)
        if any(MARK in n.lstrip(MARK) for n in self.ids):
            raise ValueError("pieces that span words are not supported")
        self.shown = [None if kind in (BYTE, CONTROL) else n.replace(MARK, " ") for n, kind in zip(self.names, self.kinds, strict=True)]
        if self.unknown is not None:
            self.shown[self.unknown] = " ⁇ "
        self.of_byte = {k: b for b, k in self.bytes_.items()}

    def __reduce__(self):
        return Transducer, (self.names, self.kinds, self.scores, self.merges, self.dummy_prefix, self.trim)

    def merged(self, text: str) -> list[str]:
        """The pieces of ``text`` by merging the best-ranked neighbours first, leftmost among equals."""
        parts = list(text)
        while True:
            best, at = -INF, -1
            for k in range(len(parts) - 1):
                own = self.ids.get(parts[k] + parts[k + 1])
                if own is not None and self.scores[own] > best:
                    best, at = self.scores[own], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def weight(self, last: int, piece: int) -> float:
        """Weight of ``piece`` after ``last`` (-1: none, or one that came from bytes, or any in a unigram model)."""
        if self.known_pairs >= PAIRS:
            self.pairs.clear()
            self.known_pairs = 0
        row = self.pairs.setdefault(last, {})
        if piece not in row:
            names = ([self.names[last]] if last >= 0 else []) + [self.names[piece]]
            row[piece] = -self.scores[piece] if not self.merges else 0.0 if self.merged("".join(names)) == names else INF
            self.known_pairs += 1
        return row[piece]

    def outside(self, text: str) -> list[int]:
        """Ids of a character in no piece: its bytes, or the unknown piece."""
        return [self.bytes_[b] for b in text.encode("utf-8", "replace")] if self.bytes_ else [self.unknown]

    def path(self, word: str) -> list[int]:
        """The shortest path through one word's composition: its piece ids.

        ``best[place]`` has, for each state of the pair machine, the least weight of a path there, where it came from, and its last piece.
        The states of a merge model are pieces; a unigram model has the one state -1, as has what came from bytes.
        """
        n, pairs, merges = len(word), self.pairs, self.merges
        best: list[dict[int, tuple[float, int, int, int]] | None] = [None] * (n + 1)
        best[0] = {-1: (0.0, -1, -1, -1)}
        for at in range(n):
            here = best[at]
            if here is None:
                continue
            for last, (cost, _, _, _) in here.items():
                row, node = pairs.get(last) or {}, self.root
                for end in range(at, n):
                    node = node.get(word[end])
                    if node is None:
                        break
                    piece = node.get("")
                    if piece is None:
                        continue
                    more = row.get(piece)
                    if more is None:
                        more = self.weight(last, piece)
                    if more == INF:
                        continue
                    state, there = piece if merges else -1, best[end + 1]
                    if there is None:
                        best[end + 1] = {state: (cost + more, at, last, piece)}
                    elif state not in there or cost + more < there[state][0]:
                        there[state] = (cost + more, at, last, piece)
            if word[at] not in self.ids:
                last, cost = min(((k, x[0]) for k, x in here.items()), key=lambda x: x[1])
                there = best[at + 1] = best[at + 1] or {}
                if -1 not in there or cost + self.fallback < there[-1][0]:
                    there[-1] = (cost + self.fallback, at, last, -1)
        out: list[int] = []
        at, last = n, min(best[n], key=lambda k: best[n][k][0])
        while at > 0:
            _, before, previous, piece = best[at][last]
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(self.outside(word[before:at])[::-1])
            at, last = before, previous
        return out[::-1]

    def encode(self, text: str) -> array:
        """Piece ids of a text."""
        out = array("i")
        out.frombytes(b"".join(map(self.words.__getitem__, _UNITS.findall(self.normalised(text)))))
        return out

    def decode(self, ids: array) -> str:
        """The text of piece ids; bytes that are no UTF-8 become replacement characters."""
        shown = list(map(self.shown.__getitem__, ids))
        if None in shown:
            out, run = [], bytearray()
            for k, piece in zip(ids, shown, strict=True):
                if piece is None and k in self.of_byte:
                    run.append(self.of_byte[k])
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                out.append(piece or "")
            out.append(run.decode("utf-8", "replace"))
            shown = out
        text = "".join(shown)
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


#: A word with the spaces before it, a line break, or spaces at an end.
_UNITS = re.compile(r" *[^ \n]+|\n| +")


def load(path: str) -> Transducer:
    """Compile a model file. Character maps of the normaliser are not supported."""
    with open(path, "rb") as f:
        raw = f.read()
    names, kinds, scores, merges, rules = [], [], [], False, {3: 1, 4: 1, 5: 1}
    for number, value in _fields(raw):
        if number == 1:
            own = dict(_fields(value))
            names.append(own[1].decode())
            scores.append(own.get(2, 0.0))
            kinds.append(own.get(3, NORMAL))
        elif number == 2:
            merges = dict(_fields(value)).get(3, 1) == 2
        elif number == 3:
            rules |= dict(_fields(value))
    if rules.get(2) or not rules[5]:
        raise ValueError("a normaliser with a character map is not supported")
    if "\n" in "".join(n for n, k in zip(names, kinds, strict=True) if k == NORMAL):
        raise ValueError("pieces with line breaks are not supported")
    return Transducer(names, kinds, scores, merges, bool(rules[3]), bool(rules[4]))


#: The transducers of this process, whose known words outlive a task.
_live: dict[str, Transducer] = {}


def _encoded(sent: Transducer, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from textloom.llm import pieces

        fst = pieces._live.setdefault(sent.key, sent)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                done = []
                part = batch.slice(lo, 256)
                for text in part.column(part.num_columns - 1).to_pylist():
                    if text is None:
                        done.append((None,) * 4)
                        continue
                    ids = fst.encode(text)
                    back = fst.decode(ids)
                    done.append((len(ids), hashlib.md5(ids.tobytes()).hexdigest() if digest else ids.tolist(), back if not digest else hashlib.md5(back.encode()).hexdigest(), back == text))
                kinds = [pa.int64(), pa.string() if digest else pa.list_(pa.int32()), pa.string(), pa.bool_()]
                columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*part.schema.names[:-1], "n_pieces", "pieces", "decoded", "exact"])

    return run


def encoded(docs: DataFrame, fst: Transducer, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id_col, n_pieces, pieces, decoded, exact) for each row of ``docs``.

    ``pieces`` are the ids (with ``digest``: the MD5 of them as little-endian 32-bit
    numbers), ``decoded`` their text again (with ``digest``: its MD5), ``exact`` whether that
    equals the text. A null text has nulls, an empty one no pieces. No rows give none.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = "string" if digest else "array<int>"
    return rows.mapInArrow(_encoded(fst, digest), f"id long, n_pieces long, pieces {kind}, decoded string, exact boolean").withColumnRenamed("id", id_col)
