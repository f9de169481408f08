"""MinHash near-dedup with DartMinHash signatures of weighted word shingles.

A document is a multiset of five-word shingles; two are near copies if the weighted Jaccard similarity of their multisets is 0.8
or more. For a signature, every unit of an element's weight throws hashed darts: a dart has a rank and a coordinate,
and each coordinate keeps its earliest dart. Darts come from regions of dyadic ranks, so documents of any size share
them, and a document only opens as many regions as it takes to hit all coordinates.

Equal texts are one class from the start. Signatures of distinct texts are joined by bands: the texts of a bucket are compared with
one of them, then with others as long as components stay apart, and what is left is compared in full. So a group of copies costs
links in proportion to its size, and no pair that meets in a bucket is lost. All links are verified exactly.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, drop_scratch, materialize, partitions, release_memory, small_batches, splitmix, table, unboxed
from .components import contracted_components, forest
from .substring import window_hashes, word_bounds, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: Bands of ROWS coordinates: a pair at similarity 0.8 misses all bands with probability (1 - 0.8^4)^20 = 3e-5.
BANDS, ROWS = 20, 4
#: The finest region holds ranks below 2^FINEST; further ones double in width up to WIDEST.
FINEST, WIDEST = -8, 256.0
#: Rounds of comparing buckets with one of their texts before whatever is left is compared.
PIVOTS = 3
#: Texts and bytes of a block, and shingles counted at once, when buckets are compared in blocks.
BLOCK, BLOCK_BYTES, SLICE = 512, 4_000_000, 2048
#: Pairs left for each bucket entry up to which they are compared one by one.
PAIRS_PER_ENTRY = 1
#: Parts that the rows of a bucket of many blocks are dealt in.
SALTS = 32
#: Characters of text taken at once for signatures.
CHUNK = 1 << 21


def shingles(text: str | None, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text (sorted) and how often each comes; a text of fewer words is one shingle of all its words."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    words = word_hashes(data, *word_bounds(data))
    found = window_hashes(words, min(width, len(words))) if len(words) else np.empty(0, np.uint64)
    return np.unique(found, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets: sum of minima over sum of maxima; 0 if both are empty."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both)


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """The Poisson quantile of uniform numbers."""
    term, below, steps = np.exp(-mean), [], 0
    total = term
    while total < 1 - 1e-15 and steps < mean + 12 * mean**0.5 + 30:
        below.append(total)
        steps += 1
        term *= mean / steps
        total += term
    return np.searchsorted(np.asarray(below), u, side="right")


def darts(units: np.ndarray, region: int, coordinates: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Darts in one region of ranks, of weight units given by their hashes: (unit index, coordinate, rank, name).

    Region 0 holds the ranks below 2^FINEST, region k those from 2^(FINEST+k-1) to 2^(FINEST+k) up to a width of WIDEST.
    A weight unit gets one dart a unit of rank on average, on any of the coordinates.
    """
    low, wide = 0.0, 2.0**FINEST
    for k in range(region):
        low, wide = low + wide, min(WIDEST, low + wide)
    seed = splitmix(units + np.uint64(0xA24BAED4963EE407 + region * 0x9FB21C651E98DF25 & (1 << 64) - 1))
    count = _poisson(_uniform(seed), wide)
    index = np.repeat(np.arange(len(units)), count)
    nth = np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count)
    name = splitmix(seed[index] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    rank = low + wide * _uniform(splitmix(name + np.uint64(1)))
    coordinate = (splitmix(name + np.uint64(2)) % np.uint64(coordinates)).astype(np.int64)
    return index, coordinate, rank, name


def signatures(elements: list[tuple[np.ndarray, np.ndarray]], coordinates: int = BANDS * ROWS) -> np.ndarray:
    """The names of the earliest darts: a row of ``coordinates`` for each weighted set; zeros for empty sets."""
    out = np.zeros((len(elements), coordinates), np.uint64)
    sizes = np.asarray([int(w.sum()) for _, w in elements], np.int64)
    if not sizes.sum():
        return out
    # A unit is one layer of an element's weight: (element, 1), (element, 2), ...
    hashes = np.concatenate([e for e, _ in elements])
    weights = np.concatenate([w for _, w in elements])
    owner = np.repeat(np.arange(len(elements)), sizes)
    layer = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(weights) - weights, weights)
    units = splitmix(np.repeat(hashes, weights) + (layer.astype(np.uint64) + np.uint64(1)) * np.uint64(0x8CB92BA72F3D8DD7))
    best_rank = np.full(out.shape, np.inf)
    open_sets = sizes > 0
    region = 0
    while open_sets.any():
        mine = np.flatnonzero(open_sets[owner])
        index, coordinate, rank, name = darts(units[mine], region, coordinates)
        cell = owner[mine[index]] * coordinates + coordinate
        order = np.argsort(rank, kind="stable")[::-1]  # the earliest is written last
        cells, ranks, names = cell[order], rank[order], name[order]
        fresh = np.full(out.size, np.inf)
        fresh[cells] = ranks
        named = np.zeros(out.size, np.uint64)
        named[cells] = names
        better = fresh.reshape(out.shape) < best_rank
        best_rank[better] = fresh.reshape(out.shape)[better]
        out[better] = named.reshape(out.shape)[better]
        open_sets &= ~np.isfinite(best_rank).all(axis=1)
        region += 1
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        key = splitmix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key


def banded(texts: DataFrame, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, keys), the keys of all bands, of each text of (id, text); texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id").to_numpy(zero_copy_only=False), batch.column("text")
            at = 0
            while at < len(ids):
                size, to = 0, at
                while to < len(ids) and (to == at or size < CHUNK):
                    size += len(texts[to].as_py() or "")
                    to += 1
                sets = [shingles(t.as_py(), width) for t in texts.slice(at, to - at)]
                full = np.flatnonzero([len(e) > 0 for e, _ in sets])
                if len(full):
                    keys = band_keys(signatures([sets[i] for i in full], bands * rows), bands, rows)
                    offsets = np.arange(0, keys.size + 1, bands, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at:to][full]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))], ["id", "keys"])
                at = to
        release_memory()

    return texts.mapInArrow(run, "id long, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE) -> DataFrame:
    """The (a, b) pairs of ids whose texts' similarity is at least ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, first = [], None, None
            for x, s, t in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb"), strict=True):
                if last is None or x != last:
                    last, first = x, shingles(s.as_py(), width)
                keep.append(similarity(first, shingles(t.as_py(), width)) >= threshold)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release_memory()

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def digested(docs: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """(id, digest, ...) of every row."""
    return docs.select(F.col(key).cast("long").alias("id"), F.md5(F.col(text).cast("binary")).alias("digest"), *more)


def text_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, digest): the smallest id of each distinct text; null texts and those without words are left out, as are rows without a key."""
    has_words = F.col(text).rlike(r"[^\x20\x09-\x0D]")
    return digested(docs.where(has_words & F.col(key).isNotNull()), key, text).groupBy("digest").agg(F.min("id").alias("id"))


def rooted(docs: DataFrame, key: str, text: str, threshold: float, width: int, bands: int, rows: int) -> DataFrame:
    """(digest, id, component_id, first): each distinct text with words, its smallest id, that of its class, and whether it comes first in it.

    A text is named by its smallest id. Of texts with one smallest id, that of the smallest digest has the name and the others get negative
    numbers from their digests.
    """
    small_batches(docs.sparkSession)
    plain = digested(docs, key, text, F.col(text).alias("text")).where("id is not null")
    classes = materialize(text_classes(docs, key, text))
    shared_ids = materialize(classes.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("leader")).where("n > 1").select("id", "leader"))
    clash = not shared_ids.isEmpty()
    if clash:
        other = F.lit(-(1 << 62)) - F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
        node = F.when(F.col("leader").isNull() | (F.col("leader") == F.col("digest")), F.col("id")).otherwise(other).alias("node")
        named = materialize(classes.join(shared_ids, "id", "left").select("id", "digest", node))
        plain = plain.join(named, ["id", "digest"], "left_semi").join(shared_ids, "id", "left").select(node.alias("id"), "text")
        drop_scratch(classes)
        classes = named
    else:
        classes, plain = classes.withColumn("node", F.col("id")), plain.select("id", "text")
    signed = banded(plain, width, bands, rows).join(classes.select(F.col("node").alias("id")), "id", "left_semi")
    buckets = materialize(signed.select("id", F.explode(F.array_distinct("keys")).alias("key")))
    least = buckets.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "a")
    shared = materialize(buckets.join(least, "key").select("key", "a", F.col("id").alias("b")))
    drop_scratch(buckets)
    texts = materialize(plain.join(shared.select(F.col("b").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"]))
    found = _settled(shared, texts, threshold, width)
    for done in (shared, texts):
        drop_scratch(done)
    root = classes.join(found.select(F.col("id").alias("node"), F.col("component_id").alias("root")), "node", "left").select("digest", "id", "node", F.coalesce("root", "node").alias("root"))
    if not clash:
        drop_scratch(shared_ids)
        return root.select("digest", "id", F.col("root").alias("component_id"), (F.col("root") == F.col("node")).alias("first"))
    heads = root.groupBy("root").agg(F.min("id").alias("component_id"))
    heads = heads.join(root.groupBy("root", "id").agg(F.min("digest").alias("head")).withColumnRenamed("id", "component_id"), ["root", "component_id"])
    return root.join(heads, "root").select("digest", "id", "component_id", (F.col("digest") == F.col("head")).alias("first"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, component_id): the class of every row, named by its smallest id.

    Null texts and texts without words are in classes of their own, as are rows without a near copy. Repeated rows share a class; rows of
    one key with different texts are classed each by its text. A null key gives a null class and joins no others. Extra columns don't
    matter. An empty table gives an empty one.
    """
    root = rooted(docs, key, text, threshold, width, bands, rows).select("digest", "component_id")
    found = digested(docs, key, text).join(root, "digest", "left")
    return found.select(F.col("id").alias(key), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows, with all their columns, of the first text of each class (that of the smallest id, then digest); one of rows equal in key and text.

    Null texts, texts without words and rows without a key are copies of nothing.
    """
    names = docs.columns
    root = rooted(docs, key, text, threshold, width, bands, rows)
    stays = (F.col("id") == F.col("component_id")) & F.col("first")
    copies = digested(docs, key, text).join(root.select("digest", "component_id", "first"), "digest").where(F.col("id").isNotNull() & ~stays).select("id", "digest").distinct()
    kept = boxed(docs, F.col(key).cast("long").alias("id"), F.md5(F.col(text).cast("binary")).alias("digest")).join(copies, ["id", "digest"], "left_anti")
    return unboxed(kept.dropDuplicates(["id", "digest"]), names)


def _settled(shared: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """(id, component_id) of linked texts, from (key, a, b): text b of bucket ``key``, whose smallest text is a.

    In up to PIVOTS rounds every bucket's texts are compared with one of them, at first the smallest and then one by chance, unless they are known to be in its
    component already: a forest of the links so far tells that, if not always. What then is left to compare in a bucket is compared in full: pair by pair
    if it is little for the number of bucket entries, and else in blocks, which give no row for a pair. All links are contracted to components once.
    """
    most, rest, before, links = PAIRS_PER_ENTRY * shared.count(), None, None, []
    pairs = shared.where("a <> b").select("a", "b")
    every = lambda: functools.reduce(DataFrame.union, links)
    for pivot in range(1, PIVOTS + 1):
        links.append(materialize(verified(pairs.distinct(), texts, threshold, width)))
        if rest is not None:
            drop_scratch(rest)
        up = forest(every())
        placed = shared.join(up.select(F.col("id").alias("b"), "up"), "b", "left").select("key", F.col("b").alias("id"), F.coalesce("up", "b").alias("part"))
        tally = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("open"))
        mixed = materialize(tally.where("open > 0"))
        left = mixed.agg(F.sum("open")).first()[0] or 0
        rest = materialize(placed.join(mixed.select("key"), "key", "left_semi"))
        for done in (mixed, up):
            drop_scratch(done)
        if left <= most or before is not None and 2 * left > before:
            break
        before = left
        chosen = rest.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(pivot)).alias("h"), F.col("id").alias("a"), F.col("part").alias("pa"))).alias("p")).select("key", "p.a", "p.pa")
        pairs = rest.join(chosen, "key").where("part <> pa").select("a", F.col("id").alias("b"))
    if left > most:
        links.append(materialize(linked_in_blocks(rest, texts, threshold, width)))
    elif left:
        x, y = rest.toDF("key", "a", "pa"), rest.toDF("key", "b", "pb")
        links.append(materialize(verified(x.join(y, "key").where("a < b and pa <> pb").select("a", "b").distinct(), texts, threshold, width)))
    joined = contracted_components(every())
    out = materialize(joined)
    for done in (rest, joined, *links):
        drop_scratch(done)
    return out


def block_links(rows: list[tuple], threshold: float, width: int) -> list[tuple[int, int]]:
    """Links that join the texts of (block, component, id, text) as all pairs of different components at the threshold or above would.

    With two blocks only pairs across them count. Shared shingle units are counted by matrix products over slices of the vocabulary.
    """
    sets = [shingles(t, width) for *_, t in rows]
    n, block, part = len(rows), np.asarray([r[0] for r in rows]), np.asarray([r[1] for r in rows])
    units = [np.repeat(e, w) + np.concatenate([np.arange(k) for k in w] or [np.empty(0, int)]).astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7) for e, w in sets]
    size = np.asarray([len(u) for u in units], np.float64)
    owner = np.repeat(np.arange(n), size.astype(int))
    _, column, times = np.unique(np.concatenate(units), return_inverse=True, return_counts=True)
    common = times[column] > 1
    number = np.cumsum(times > 1) - 1
    owner, column = owner[common], number[column[common]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((n, n), np.float32)
    for lo in range(0, int((times > 1).sum()), SLICE):
        begin, end = np.searchsorted(column, (lo, lo + SLICE))
        present = np.zeros((n, SLICE), np.float32)
        present[owner[begin:end], column[begin:end] - lo] = 1
        shared += present @ present.T
    near = shared / np.maximum(size[:, None] + size - shared, 1) >= threshold
    near &= part[:, None] != part
    if block.min() != block.max():
        near &= block[:, None] != block
    label, before = np.arange(n), None
    while before is None or (label != before).any():
        before = label
        label = np.minimum(label, np.where(near, label, n).min(axis=1))
        label = label[label]
    ids = [r[2] for r in rows]
    return [(ids[k], ids[i]) for i, k in enumerate(label) if i != k]


def linked_in_blocks(rest: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """(a, b) links across the components of each bucket of (key, id, part).

    A bucket is cut into blocks of bounded size, and each two blocks (and each alone) meet in a cell, a task's unit of work.
    """
    sized = rest.join(texts.select("id", F.octet_length("text").alias("bytes")), "id")
    blocks = sized.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    large = blocks.where("blocks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # hot keys meet by (key, salt)
    dealt = rest.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(SALTS)).cast("int")).join(large, ["key", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select(F.xxhash64("key", F.least("block", "with"), F.greatest("block", "with")).alias("cell"), "block", "part", "id").join(texts, "id").select("cell", "block", "part", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[tuple]) -> pa.RecordBatch:
            links = block_links(rows, threshold, width) if len({r[1] for r in rows}) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        at, rows = None, []
        for batch in batches:
            for cell, *row in zip(*(batch.column(c).to_pylist() for c in ("cell", "block", "part", "id", "text")), strict=True):
                if cell != at and rows:
                    yield solve(rows)
                    rows = []
                at = cell
                rows.append(tuple(row))
        if rows:
            yield solve(rows)
        release_memory()

    return cells.repartition(partitions(rest.sparkSession), "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long").distinct()


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document, and whether it is the one that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
