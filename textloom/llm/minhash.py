"""Near-duplicate documents: one-permutation MinHash with optimal densification.

Every document's shingle set is hashed once; its hash range is cut into bins and
each bin keeps its minimum. Empty bins borrow from the first non-empty bin along
a fixed random order of their own (optimal densification), so small sets behave
like large ones. Groups of ``rows`` bins form ``bands`` buckets. At 5 rows and 40
bands a pair at similarity 0.8 shares no bucket with probability 1.2e-7.

Copies with equal sets are one node from the start. A bucket emits star edges
only: a centre, drawn by hash anew for each bucket, against the others, so that a
document meets up to ``bands`` centres. Links are confirmed on the full sets. Rounds of
new centres follow while more of the compared pairs are links than are not, over buckets
whose nodes have not all met in one component.

What is then still apart is finished exactly. The nodes of open buckets are joined by their
rarest shingles (prefixes): two sets at the threshold must share a shingle that leaves enough
behind it in both, in the order from rare to common. The parities of the shingles that fall into each of ``ODD``
classes differ in no more classes than the sets differ in shingles, which rules out most of what is left.
Neither test loses a link, so every link between two nodes of an open bucket is found or already within a component. Before sets are
fetched in the star rounds, two bits of each bin's minimum must agree as often as those of sets
at the threshold do, less five standard deviations; what that refuses the finish looks at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import textkernel as tk
from textloom.llm.graph import components
from textloom.llm.shared import bounded_batches, packed, written

NGRAM, THRESHOLD, BANDS, ROWS = 5, 80, 40, 5
#: Entries listed under one shingle that a task of the exact finish holds.
BLOCK = 4096
#: Classes of shingles whose parities an entry of the exact finish carries.
ODD = 2048


def _orders(bins: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    return np.stack([rng.permutation(bins) for _ in range(bins)]).astype(np.int32)


def one_permutation(sets: list[np.ndarray], bins: int, orders: np.ndarray) -> np.ndarray:
    """Bin minima [documents, bins] of sorted hash sets, densified. Sets must not be empty."""
    edges = ((np.arange(bins, dtype=object) << 64) // bins).astype(np.uint64)
    out, full = np.empty((len(sets), bins), np.uint64), np.empty((len(sets), bins), bool)
    for k, own in enumerate(sets):
        at = np.searchsorted(own, edges)
        full[k, :-1] = at[1:] > at[:-1]
        full[k, -1] = at[-1] < len(own)
        out[k] = own[np.minimum(at, len(own) - 1)]
    doc, empty = np.nonzero(~full)
    for turn in range(bins):
        if not len(doc):
            break
        source = orders[empty, turn]
        hit = full[doc, source]
        out[doc[hit], empty[hit]] = out[doc[hit], source[hit]]
        doc, empty = doc[~hit], empty[~hit]
    return out


def _band_hashes(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grouped = minima.reshape(len(minima), bands, rows)
    out = np.zeros(grouped.shape[:2], np.uint64)
    for k in range(rows):
        out = tk.mix(out + grouped[:, :, k])
    return tk.mix(out + np.arange(bands, dtype=np.uint64))


def _planes(minima: np.ndarray) -> np.ndarray:
    """Two bits of each bin's scrambled minimum, packed into words: all first bits, then all second bits."""
    bits = tk.mix(minima)
    width = -(-minima.shape[1] // 64) * 64
    out = []
    for k in (0, 1):
        plane = np.zeros((len(minima), width), bool)
        plane[:, : minima.shape[1]] = (bits >> np.uint64(17 + k)) & np.uint64(1)
        out.append(np.packbits(plane, axis=1).view(np.uint64))
    return np.concatenate(out, axis=1)


def _lists(held: np.ndarray, values: np.ndarray) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(held * values.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


def _signatures(ngram: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders(bands * rows)
        for batch in batches:
            data, offs = tk.buffers(batch.column(1))
            for lo, hi in tk.slices(offs):
                sets = tk.shingle_sets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], ngram)
                sizes = np.array([len(s) for s in sets], np.int64)
                keys = np.array([(s.sum(dtype=np.uint64), tk.mix(s).sum(dtype=np.uint64)) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
                held = np.flatnonzero(sizes)
                minima = one_permutation([sets[k] for k in held], bands * rows, orders) if len(held) else np.zeros((0, bands * rows), np.uint64)
                hashes, planes = _band_hashes(minima, bands, rows), _planes(minima)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(sizes), pa.array(keys[:, 0]), pa.array(keys[:, 1]), _lists(sizes > 0, hashes), _lists(sizes > 0, planes)],
                    ["id", "size", "k1", "k2", "bands", "sketch"],
                )

    return run


def _sets(ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tk.buffers(batch.column(1))
            for lo, hi in tk.slices(offs):
                sets = tk.shingle_sets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], ngram)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["id", "items"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (u, v) whose full sets are alike enough."""
    a, b = sets.select(F.col("id").alias("u"), F.col("items").alias("a")), sets.select(F.col("id").alias("v"), F.col("items").alias("b"))
    both = packed(packed(pairs.join(a, "u")).join(b, "v")).select("u", "v", (F.size("a") + F.size("b")).alias("n"), F.size(F.array_intersect("a", "b")).alias("same"))
    return both.where((100 * F.col("same")) >= threshold * (F.col("n") - F.col("same"))).select("u", "v").distinct()


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends the parity of the number of shingles in each class, as words of 64 classes; the shingles are the last column."""
    for batch in batches:
        items = batch.column(batch.num_columns - 1)
        owner = np.repeat(np.arange(len(items)), items.value_lengths().to_numpy(zero_copy_only=False))
        seen = items.flatten().to_numpy().view(np.uint64) >> np.uint64(64 - ODD.bit_length() + 1)
        odd = np.bincount(owner * ODD + seen.astype(np.int64), minlength=len(items) * ODD).reshape(len(items), ODD) & 1
        words = np.packbits(odd.astype(bool), axis=1).view(np.int64)
        ends = pa.array(np.arange(len(items) + 1, dtype=np.int32) * (ODD // 64))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(words.ravel()))], [*batch.schema.names, "odd"])


def _least_common(threshold: int, sizes: Column | str) -> Column:
    """The fewest common shingles of two sets of ``sizes`` shingles together that reach the threshold."""
    return F.ceil(threshold * (F.col(sizes) if isinstance(sizes, str) else sizes) / (100 + threshold))


def _prefixes(held: DataFrame, threshold: int) -> DataFrame:
    """(item, entry, id, component, size, odd, left) of the shingles by which an entry can first meet another.

    Shingles are ordered from rare to common over ``held`` and ``left`` counts those from a
    shingle on. Two sets at the threshold have their first common shingle where enough are
    left in both. Shingles of one entry alone take their places in the order, but never meet.
    """
    each = held.select("entry", F.explode("items").alias("item"))
    often = each.groupBy("item").agg(F.count("*").alias("n")).where("n > 1")
    order = packed(each.join(often, "item")).groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("order"))
    size = F.size("items").cast("long")
    own = held.select("entry", "id", "component", "odd", size.alias("size"), (size - F.ceil(threshold * size / 100) + 1).alias("prefix"))
    near = packed(own.join(order, "entry")).withColumn("alone", F.col("size") - F.size("order"))
    places = near.select("entry", "id", "component", "odd", "size", "alone", F.posexplode(F.slice("order", F.lit(1), F.greatest(F.col("prefix") - F.col("alone"), F.lit(0)).cast("int"))).alias("at", "shingle"))
    return places.select(F.col("shingle.item").alias("item"), "entry", "id", "component", "size", "odd", (F.col("size") - F.col("alone") - F.col("at")).alias("left"))


def _rest(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """All links (u, v) between components among the nodes of ``members``.

    Sets that reach the threshold are found by their rarest shingles: the smaller one is listed under those
    that leave enough even for a partner of its own size, the larger one looks them up, and both must leave
    enough for their sizes. No two documents are compared that these counts rule out, and none
    that qualify are missed. A shingle of many entries is dealt in blocks.
    """
    nodes = packed(members.groupBy("id").agg(F.first("component").alias("component")))
    held = packed(nodes.join(sets, "id")).select("id", "component", F.monotonically_increasing_id().alias("entry"), "items")
    held = written(held.mapInArrow(_parities, "id long, component long, entry long, items array<long>, odd array<long>"), "open")
    prefixes = written(packed(_prefixes(held, threshold)), "prefixes")
    listed = prefixes.where(F.col("left") >= _least_common(threshold, 2 * F.col("size")))
    blocks = listed.groupBy("item").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    asking = packed(prefixes.join(blocks, "item")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    listed = packed(listed.join(blocks, "item")).withColumn("block", F.pmod(F.xxhash64("entry"), "blocks").cast("int"))
    a, b = F.struct("a.size", "a.entry"), F.struct("b.size", "b.entry")
    both = F.col("a.size") + F.col("b.size")
    apart = F.aggregate(F.zip_with("a.odd", "b.odd", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    enough = (F.least("a.left", "b.left") >= _least_common(threshold, both)) & (apart <= both - 2 * _least_common(threshold, both))
    met = asking.alias("a").join(listed.alias("b"), (F.col("a.item") == F.col("b.item")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.component") != F.col("b.component")) & (a > b) & enough)
    pairs = written(packed(packed(met).select(F.greatest("a.id", "b.id").alias("u"), F.least("a.id", "b.id").alias("v")).distinct()), "last")
    return _confirmed(pairs, sets, threshold)


def _alike(a: str, b: str, threshold: int, bins: int) -> Column:
    """Whether sets ``a`` and ``b`` may reach the threshold, by their sizes and sketches."""
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    half = -(-bins // 64)
    apart = sum((F.bit_count(F.col(f"{a}.sketch")[k].bitwiseXOR(F.col(f"{b}.sketch")[k]).bitwiseOR(F.col(f"{a}.sketch")[k + half].bitwiseXOR(F.col(f"{b}.sketch")[k + half]))) for k in range(half)), F.lit(0))
    rate = 0.75 * (1 - threshold / 100)
    return (100 * F.least(x, y) >= threshold * F.greatest(x, y)) & (apart <= int(bins * rate + 5 * (bins * rate * (1 - rate)) ** 0.5 + 1))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ngram: int = NGRAM,
    threshold: int = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row (id_col, n_shingles, component_id, kept) for each row of ``docs``.

    Documents are linked if ``100 * |A & B| >= threshold * |A | B|`` for their sets
    of ``ngram``-word shingles (as 64-bit hashes) of A-Z lower-cased words. With
    fewer words the whole sequence is the one shingle; an empty, blank or null text
    has no shingles and is linked with nothing. ``component_id`` is the smallest id
    reachable over links, itself included. Rows that share an id are one document of
    several texts. A null id has a null component and is kept. No rows give none.
    """
    bounded_batches(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = written(text.mapInArrow(_signatures(ngram, bands, rows), "id long, size long, k1 long, k2 long, bands array<long>, sketch array<long>"), "signatures")
    classes = signed.where("size > 0 and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("node"), F.min("size").alias("size"))
    classes = written(classes, "classes")
    nodes = signed.where("size > 0").join(classes.select("k1", "k2", F.col("node").alias("id")), ["k1", "k2", "id"], "left_semi").dropDuplicates(["id", "k1", "k2"])
    placed = nodes.select("id", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    grouped = placed.join(shared, "bucket", "left_semi")
    members = written(grouped.join(nodes.select("id", "size", "sketch"), "id"), "members")
    near = _alike("a", "b", threshold, bands * rows)

    def stars(labelled: DataFrame, turn: int) -> DataFrame:
        """Pairs of each bucket's centre of this turn and what is not joined to it."""
        centres = labelled.groupBy("bucket").agg(F.min_by(F.struct("id", "size", "sketch", "component"), F.xxhash64("id", "bucket", F.lit(turn))).alias("c"))
        centres = packed(centres).select("bucket", "c.*")
        met = labelled.alias("a").join(centres.alias("b"), (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.component") != F.col("b.component")) & near)
        return packed(met).select(F.greatest("a.id", "b.id").alias("u"), F.least("a.id", "b.id").alias("v")).distinct()

    involved = members.select("id").distinct()
    sets = written(text.where("id is not null").join(involved, "id", "left_semi").mapInArrow(_sets(ngram), "id long, items array<long>"), "sets")
    members, turn, pairs, links = members.withColumn("component", F.col("id")), 0, None, None
    while True:
        fresh = stars(members, turn)
        fresh = written(packed(fresh if pairs is None else packed(fresh).join(pairs, ["u", "v"], "left_anti")), "pairs")
        found = written(packed(_confirmed(fresh, sets, threshold)), "links")
        pairs, links = (fresh, found) if pairs is None else (pairs.unionByName(fresh), links.unionByName(found))
        joined = written(components(links if not turn else joined.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(found)).transform(packed), "joined")
        labelled = written(packed(members.drop("component").join(joined, "id", "left")).withColumn("component", F.coalesce("component", "id")), "labelled")
        mixed = labelled.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n")).where("least <> most and n > 2").select("bucket")
        members, turn = written(packed(labelled.join(packed(mixed), "bucket", "left_semi")), "open"), turn + 1
        if 2 * found.count() <= fresh.count():
            break

    rest = written(packed(_rest(members, sets, threshold)), "rest")
    if not rest.isEmpty():
        links = links.unionByName(rest)
        joined = written(components(joined.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(rest)).transform(packed), "joined")

    copies = signed.where("size > 0").join(classes.drop("size"), ["k1", "k2"]).where("id <> node").select(F.col("id").alias("u"), F.col("node").alias("v"))
    repeated = signed.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    if not repeated.isEmpty():  # an id with several texts joins the classes of all of them
        joined = components(links.unionByName(copies.join(repeated.select(F.col("id").alias("u")), "u", "left_semi")))
    labels = classes.join(joined.withColumnRenamed("id", "node"), "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component_id"))
    out = signed.select("id", F.col("size").alias("n_shingles"), "k1", "k2").join(labels, ["k1", "k2"], "left")
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


#: The same rows by comparing all documents that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
