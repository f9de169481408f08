"""Embedding near-dedup with spherical-cap filters.

A filter is a direction; a vector passes it if their inner product reaches a threshold, that is if it lies in the filter's cap.
The directions form random product codes: the space is rotated and cut into blocks with a few random code vectors each, and every choice
of one vector a block is a direction. A vector's filters are listed from the block products by pruned sums, without visiting the others.
Vectors that share a filter and whose sign sketches are near are verified by cosine in double precision.

The number of directions follows the number of vectors, and the filters of each vector in a code stay the same. The number of codes is
fitted on random pairs at the threshold, for the length of the vectors and the size of the table, so that the share of missed pairs
doesn't grow with the table. Filters of many vectors are cut into cells of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, matrix, partitions, splitmix, table, usable
from .components import connected_components

THRESHOLD = 0.9
#: Codes at least, mean number of filters of a random vector in each, vectors of the table for each direction of a code, directions at least.
#: So a filter has about PASSED x SPACING vectors, which are cheap to compare, and a vector few filters, whose rows are not.
CODES, PASSED, SPACING, LEAST_DIRECTIONS = 4, 4, 32, 256
#: Random pairs at the threshold that the number of codes is fitted on, the share of them that may meet in no filter, codes at most.
TRIALS, MISSED, MOST_CODES = 4000, 0.002, 32
#: Code vectors of a block at most; more directions take more blocks.
BLOCK_SIZE = 16_384
#: Vectors whose block products are held at a time.
ROWS = 512
#: The most frequent lengths of vectors that codes are fitted for, so many at most; others take MOST_CODES.
FITTED = 8
#: Bits of a sketch, and the differing bits allowed: vectors at cosine 0.9 differ in 18.4 +- 4, beyond 38 once in two million.
SKETCH, DIFFER = 128, 38
#: Vectors in a cell of a filter.
CELL = 2048


@lru_cache(maxsize=32)
def product_code(dim: int, seed: int, vectors: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(rotation, code vectors of each block as columns, first dimension of each block) for a table of so many vectors."""
    wanted = max(vectors / SPACING, LEAST_DIRECTIONS)
    blocks = min(dim, max(2, int(np.ceil(np.log(wanted) / np.log(BLOCK_SIZE)))))
    size = int(np.ceil(wanted ** (1 / blocks)))
    draw = np.random.default_rng([dim, seed])
    rotation = np.linalg.qr(draw.standard_normal((dim, dim)))[0]
    cuts = np.linspace(0, dim, blocks + 1).astype(int)
    code = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        c = draw.standard_normal((hi - lo, size))
        code.append(c / np.linalg.norm(c, axis=0) / np.sqrt(blocks))
    return rotation, code, cuts


def list_decode(products: list[np.ndarray], threshold: float) -> np.ndarray:
    """The numbers of all directions whose block products sum to the threshold or more: sums that can't reach it are cut block by block."""
    best = [p.max() for p in products]
    sums, number = np.zeros(1), np.zeros(1, np.int64)
    for k, p in enumerate(products):
        rest = sum(best[k + 1 :])
        mine = np.flatnonzero(p >= threshold - rest - sums.max())
        total = sums[:, None] + p[mine]
        i, j = np.nonzero(total >= threshold - rest)
        sums, number = total[i, j], number[i] * len(p) + mine[j]
        if not len(sums):
            break
    return number


def block_products(unit: np.ndarray, code: tuple) -> list[np.ndarray]:
    rotation, blocks, cuts = code
    turned = unit @ rotation
    return [turned[:, lo:hi] @ c for lo, hi, c in zip(cuts[:-1], cuts[1:], blocks, strict=True)]


@lru_cache(maxsize=32)
def cap_threshold(dim: int, vectors: int) -> float:
    """The inner product that a random vector reaches with PASSED directions on average, from random vectors, not the data."""
    draw = np.random.default_rng(dim)
    unit = draw.standard_normal((64, dim))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    products = block_products(unit, product_code(dim, 0, vectors))
    threshold = float(max(sum(p[i].max() for p in products) for i in range(len(unit))))
    while np.mean([len(list_decode([p[i] for p in products], threshold)) for i in range(len(unit))]) < PASSED:
        threshold -= 0.002
    return threshold


def missed(dim: int, vectors: int, threshold: float, most: int) -> Iterator[float]:
    """The share of random pairs at a cosine of ``threshold`` that share no filter in the first code, the first two and so on, ``most`` at most."""
    draw = np.random.default_rng([dim, 2])
    x, side = draw.standard_normal((2, TRIALS, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side -= np.einsum("ij,ij->i", side, x)[:, None] * x
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * side / np.linalg.norm(side, axis=1)[:, None]
    cap = cap_threshold(dim, vectors)
    for seed in range(most):
        code, apart = product_code(dim, seed, vectors), np.ones(len(x), bool)
        for at in range(0, len(x), ROWS):
            px, py = block_products(x[at : at + ROWS], code), block_products(y[at : at + ROWS], code)
            for i in range(len(px[0])):
                apart[at + i] = not np.intersect1d(list_decode([p[i] for p in px], cap), list_decode([p[i] for p in py], cap), assume_unique=True).size
        x, y = x[apart], y[apart]
        yield len(x) / TRIALS


@lru_cache(maxsize=32)
def code_count(dim: int, vectors: int, threshold: float) -> int:
    """The codes that leave at most MISSED of random pairs at the threshold without a common filter, between CODES and MOST_CODES."""
    if dim < 2:
        return CODES
    for codes, share in enumerate(missed(dim, vectors, threshold, MOST_CODES), 1):
        if share <= MISSED:
            return max(CODES, codes)
    return MOST_CODES


@lru_cache(maxsize=32)
def _sketch_planes(dim: int) -> np.ndarray:
    return np.random.default_rng([dim, 1 << 20]).standard_normal((dim, SKETCH))


def sketches(unit: np.ndarray) -> np.ndarray:
    """Signs of random projections as two 64-bit words."""
    return np.packbits(unit @ _sketch_planes(unit.shape[1]) >= 0, axis=1).view(np.int64)


def postings(vectors: DataFrame, count: int, codes: dict[int, int]) -> DataFrame:
    """(filter, least, id, s1, s2) for every filter that a vector of (id, vec) passes; ``least`` is the smallest filter it passes in that code.

    ``codes`` holds the number of codes for each length of a vector; MOST_CODES where it has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths = batch.column("id").to_numpy(zero_copy_only=False), batch.column("vec").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                same = np.flatnonzero(lengths == dim)
                for mine in np.split(same, range(ROWS, len(same), ROWS)):
                    x = matrix(batch.column("vec").take(pa.array(mine)))
                    x /= np.abs(x).max(axis=1)[:, None]
                    x /= np.linalg.norm(x, axis=1)[:, None]
                    threshold, sketch, most = cap_threshold(int(dim), count), sketches(x), codes.get(int(dim), MOST_CODES)
                    for seed in range(most):
                        products = block_products(x, product_code(int(dim), seed, count))
                        found = [list_decode([p[i] for p in products], threshold) for i in range(len(x))]
                        n = np.asarray([len(f) for f in found])
                        if not n.sum():
                            continue
                        key = splitmix(np.concatenate(found).astype(np.uint64) * np.uint64(most) + np.uint64(seed) + splitmix(np.asarray([dim]))).view(np.int64)
                        full = n > 0
                        least = np.repeat(np.minimum.reduceat(key, (np.cumsum(n) - n)[full]), n[full])
                        who = np.repeat(np.arange(len(x)), n)
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, least, ids[mine][who], sketch[who, 0], sketch[who, 1])], ["filter", "least", "id", "s1", "s2"])

    return vectors.mapInArrow(run, "filter long, least long, id long, s1 long, s2 long")


def in_cells(posted: DataFrame, heavy: DataFrame) -> DataFrame:
    """(cell, part, ...): those of more than CELL vectors are cut into parts, and each two parts meet in a cell."""
    plain = posted.select(F.xxhash64("filter", F.lit(0), F.lit(0)).alias("cell"), F.lit(0).alias("part"), F.lit(-1).alias("other"), "filter", "least", "id", "s1", "s2")
    if heavy.isEmpty():
        return plain
    light = posted.join(heavy.select("filter"), "filter", "left_anti").select(F.xxhash64("filter", F.lit(0), F.lit(0)).alias("cell"), F.lit(0).alias("part"), F.lit(-1).alias("other"), "filter", "least", "id", "s1", "s2")
    cut = posted.join(heavy, "filter").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.xxhash64("filter", F.least("part", "with"), F.greatest("part", "with"))
    return light.union(cut.select(cell.alias("cell"), "part", F.when(F.col("part") == F.col("with"), -1).otherwise(F.col("with")).alias("other"), "filter", "least", "id", "s1", "s2"))


def _meet(cells: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one cell with near sketches, from rows sorted by cell. Of pairs whose least filters agree, only that filter gives the pair."""
    names = ["cell", "filter", "part", "other", "least", "id", "s1", "s2"]

    def solve(c: dict[str, np.ndarray]) -> pa.RecordBatch:
        n, step, found = len(c["id"]), 1, []
        at = np.arange(n - 1)
        while len(at):
            at = at[at + step < n]
            at = at[(c["cell"][at] == c["cell"][at + step]) & (c["filter"][at] == c["filter"][at + step])]
            i, j = at, at + step
            near = np.bitwise_count((c["s1"][i] ^ c["s1"][j]).view(np.uint64)).astype(np.int16) + np.bitwise_count((c["s2"][i] ^ c["s2"][j]).view(np.uint64)) <= DIFFER
            near &= (c["id"][i] != c["id"][j]) & ((c["least"][i] != c["least"][j]) | (c["least"][i] == c["filter"][i]))
            near &= (c["part"][i] != c["part"][j]) | (c["other"][i] == -1)
            found.append(np.stack([np.minimum(c["id"][i[near]], c["id"][j[near]]), np.maximum(c["id"][i[near]], c["id"][j[near]])]))
            step += 1
        a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])

    rest = None
    for batch in cells:
        new = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
        rest = new if rest is None else {k: np.concatenate([rest[k], new[k]]) for k in names}
        last = np.searchsorted(rest["cell"], rest["cell"][-1]) if len(rest["cell"]) else 0
        if last:
            yield solve({k: v[:last] for k, v in rest.items()})
            rest = {k: v[last:] for k, v in rest.items()}
    if rest is not None and len(rest["cell"]):
        yield solve(rest)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = whole.column("va").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                yield linked(whole.filter(pa.array(lengths == dim)))

    def linked(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = matrix(batch.column("va")), matrix(batch.column("vb"))
        x, y = x / np.abs(x).max(axis=1)[:, None], y / np.abs(y).max(axis=1)[:, None]
        cosine = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
        return batch.select(["a", "b"]).filter(pa.array(cosine >= threshold))

    return run


def near_links(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b), a < b: the linked pairs found among usable vectors of (id, vec) with distinct ids, a stored table. Vectors of different lengths don't link."""
    sizes = {r["dim"]: r["n"] for r in vectors.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one number a length
    count = sum(sizes.values())
    often = sorted(sizes, key=lambda d: (-sizes[d], d))[:FITTED]
    posted = materialize(postings(vectors, count, {d: code_count(d, count, threshold) for d in often}))
    sizes = posted.groupBy("filter").agg(F.count(F.lit(1)).alias("n"))
    heavy = materialize(sizes.where(F.col("n") > CELL).select("filter", F.ceil(F.col("n") / CELL).cast("int").alias("parts")))
    cells = in_cells(posted, heavy)
    dealt = cells.repartition(partitions(vectors.sparkSession), "cell").sortWithinPartitions("cell", "filter")
    pairs = dealt.mapInArrow(_meet, "a long, b long").distinct()
    left, right = vectors.select(F.col("id").alias("a"), F.col("vec").alias("va")), vectors.select(F.col("id").alias("b"), F.col("vec").alias("vb"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb").where(F.size("va") == F.size("vb"))
    links = materialize(met.mapInArrow(_verify(threshold), "a long, b long"))
    for done in (posted, heavy):
        drop_scratch(done)
    return links


def dedup_embeddings(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows without a key. Repeated rows
    of a key count as one vector, that of the smallest digest, and have the same result. Extra columns don't matter. An empty table gives an
    empty one.

    Equal vectors are linked without being compared: their smallest key stands for all, with their number (two 64-bit hashes tell vectors apart).
    """
    ids = df.select(F.col(key).cast("long").alias("id"))
    digest = F.struct(F.xxhash64(F.col(vector)).alias("h"), F.xxhash64(F.lit(1), F.col(vector)).alias("g")).alias("digest")
    vectors = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec"), digest).where(usable(F.col("vec")) & F.col("id").isNotNull())
    placed = vectors.groupBy("id").agg(F.min("digest").alias("digest"))
    classes = materialize(placed.groupBy("digest").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("equal")))
    heads = materialize(vectors.join(classes.select(F.col("node").alias("id"), "digest"), ["id", "digest"], "left_semi").dropDuplicates(["id"]).select("id", "vec"))
    links = near_links(heads, threshold)
    drop_scratch(heads)
    other = classes.select(F.col("node").alias("b"), F.col("equal").alias("others"))
    counts = links.union(links.select("b", "a")).join(other, "b").groupBy(F.col("a").alias("node")).agg(F.sum("others").alias("others"))
    components = connected_components(links).withColumnRenamed("id", "node")
    known = counts.join(components, "node")
    member = placed.join(classes, "digest").select("id", "node", "equal").join(known, "node", "left")
    of_node = F.coalesce("component_id", "node", "id")
    return ids.join(member, "id", "left").select(
        F.col("id").alias(key), (F.coalesce(F.col("equal") - 1, F.lit(0)) + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), of_node.alias("component_id"), F.col("id").eqNullSafe(of_node).alias("kept")
    )


def op1_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9 or more."""
    return dedup_embeddings(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT * FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
r(id, root) AS (SELECT vec_id, vec_id FROM e UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id
"""
