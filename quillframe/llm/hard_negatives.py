"""Hard negatives from a vector-approximation file.

Vectors lie in blocks. A block quantises each dimension into cells with borders of its own, and holds a byte for each component (the
approximation) beside the vectors themselves. For an anchor, the borders of a vector's cells, looked up in the block's table, bound their inner product
from below and above. Only vectors whose bounds may bring them among an anchor's nearest, or into one of its windows, are scored exactly.

Anchors are a stated set. They are packed into blocks, too, and every block of anchors meets every block of vectors; a meeting
gives at most the wanted number of rows for an anchor or window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, matrix, partitions, release_memory, small_batches, table

#: Cells of a dimension (a byte numbers them), vectors of a block, anchors of a block.
CELLS, BLOCK, ANCHORS = 64, 4096, 512
#: Anchors whose bounds are held at once.
ROWS = 128
#: Bytes of anchors that meet a part of the blocks at once.
ANCHOR_BYTES = 32_000_000

_BLOCKS = "dim int, ids binary, labels binary, borders binary, codes binary, exact binary"
_ANCHORS = "dim int, ids binary, labels binary, exact binary, positives binary, scores binary"


def fine_vector(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, and no null or non-finite component. Never null itself."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def quantised(x: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """(borders, codes): the borders of each dimension's cells (the first is its least value, the last its greatest) and every component's cell."""
    borders = np.quantile(x, np.linspace(0, 1, cells + 1), axis=0, method="nearest").T.copy()
    codes = np.empty(x.shape, np.uint8)
    for d, edge in enumerate(borders):
        codes[:, d] = np.clip(np.searchsorted(edge, x[:, d], side="right") - 1, 0, cells - 1)
    return borders, codes


def bounds(anchors: np.ndarray, borders: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the inner product of each anchor (row) with each approximated vector (column)."""
    dims = np.arange(len(borders))
    low, high = borders[dims, codes], borders[dims, codes + np.uint8(1)]
    plus, minus = np.maximum(anchors, 0), np.maximum(-anchors, 0)
    slack = 4 * len(borders) * np.finfo(float).eps * np.abs(borders).max() * np.abs(anchors).sum(axis=1)[:, None]  # of rounding
    return plus @ low.T - minus @ high.T - slack, plus @ high.T - minus @ low.T + slack


def _may_enter(able: np.ndarray, sure: np.ndarray, lower: np.ndarray, upper: np.ndarray, most: int) -> np.ndarray:
    """Of the ``able``, those that may be among the first ``most`` of a row: their upper bound reaches the ``most``-th lower bound of the ``sure``."""
    if lower.shape[1] <= most:
        return able
    least = np.partition(np.where(sure, lower, -np.inf), -most, axis=1)[:, -most]
    return able & (upper >= least[:, None])


def _first(row: np.ndarray, score: np.ndarray, number: np.ndarray, most: int) -> np.ndarray:
    """Positions of the ``most`` highest scores of each row, ties to the smaller number."""
    order = np.lexsort((number, -score, row))
    row = row[order]
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, int)
    rank = np.arange(len(row)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(row)]])))
    return order[rank < most]


def _exact(anchors: np.ndarray, vectors: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", anchors[i[at : at + 65_536]], vectors[j[at : at + 65_536]]) for at in range(0, len(i), 65_536)] or [np.empty(0)])


def nearest_alike(anchor: dict, block: dict, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor row, vector row, score) of the ``most`` highest-scoring vectors of a block with the anchor's label, the anchor itself left out."""
    lower, upper = bounds(anchor["exact"], block["borders"], block["codes"])
    alike = (anchor["labels"][:, None] == block["labels"]) & (anchor["ids"][:, None] != block["ids"])
    i, j = np.nonzero(_may_enter(alike, alike, lower, upper, most))
    score = _exact(anchor["exact"], block["exact"], i, j)
    kept = _first(i, score, block["ids"][j], most)
    return i[kept], j[kept], score[kept]


def in_windows(anchor: dict, block: dict, most: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of an anchor's positives (by place): (place, anchor row, vector row, score) of the first ``most`` of other labels in its window.

    A window holds scores s with ``low * p <= 100 * s <= high * p`` for a positive's score p.
    """
    lower, upper = bounds(anchor["exact"], block["borders"], block["codes"])
    other = anchor["labels"][:, None] != block["labels"]
    for place in range(anchor["scores"].shape[1]):
        p = anchor["scores"][:, place, None]  # not a number where there is none: nothing compares with it
        able = other & (100 * upper >= low * p) & (100 * lower <= high * p)
        sure = able & (100 * lower >= low * p) & (100 * upper <= high * p)
        i, j = np.nonzero(_may_enter(able, sure, lower, upper, most))
        score, p = _exact(anchor["exact"], block["exact"], i, j), p[i, 0]
        inside = np.flatnonzero((low * p <= 100 * score) & (100 * score <= high * p))
        kept = inside[_first(i[inside], score[inside], block["ids"][j[inside]], most)]
        yield place, i[kept], j[kept], score[kept]


def _packed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, vec) rows as blocks of at most BLOCK vectors of one length."""
    held: dict[int, list[tuple]] = {}

    def pack(dim: int, parts: list[tuple]) -> pa.RecordBatch:
        ids, labels, x = (np.concatenate(p) for p in zip(*parts, strict=True))
        borders, codes = quantised(x)
        row = [a.tobytes() for a in (ids, labels, borders, codes, x)]
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *[pa.array([b], pa.binary()) for b in row]], ["dim", "ids", "labels", "borders", "codes", "exact"])

    for batch in batches:
        for dim, *columns in _by_length(batch):
            parts = held.setdefault(dim, [])
            parts.append(tuple(columns))
            if sum(len(p[0]) for p in parts) >= BLOCK:
                whole = [np.concatenate(p) for p in zip(*parts, strict=True)]
                cut = len(whole[0]) // BLOCK * BLOCK
                for at in range(0, cut, BLOCK):
                    yield pack(dim, [tuple(c[at : at + BLOCK] for c in whole)])
                held[dim] = [tuple(c[cut:] for c in whole)]
    for dim, parts in held.items():
        if sum(len(p[0]) for p in parts):
            yield pack(dim, parts)
    release_memory()


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    lengths = batch.column("vec").value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        mine = batch.filter(pa.array(lengths == dim))
        yield int(dim), *(mine.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "label")), matrix(mine.column("vec"))


def _packed_anchors(most: int):
    """(id, label, vec, found) rows as blocks of at most ANCHORS anchors of one length; ``found`` holds an anchor's positives as (id, score), best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ANCHORS):
                part = batch.slice(at, ANCHORS)
                lengths = part.column("vec").value_lengths().to_numpy(zero_copy_only=False)
                for dim, ids, labels, x in _by_length(part):
                    numbers, scores = np.zeros((len(ids), most), np.int64), np.full((len(ids), most), np.nan)
                    for k, found in enumerate(part.filter(pa.array(lengths == dim)).column("found").to_pylist()):
                        for place, f in enumerate(found or ()):
                            numbers[k, place], scores[k, place] = f["id"], f["score"]
                    row = [a.tobytes() for a in (ids, labels, x, numbers, scores)]
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *[pa.array([b], pa.binary()) for b in row]], ["dim", "ids", "labels", "exact", "positives", "scores"])

    return run


def _met(solve: Callable[[dict, dict], Iterator[tuple]], names: list[str]):
    """Runs ``solve`` on each (block of anchors, block of vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw = {c: batch.column(c)[k].as_py() for c in batch.schema.names if c not in ("dim", "part", "ward")}
                dim = batch.column("dim")[k].as_py()
                block = {"ids": np.frombuffer(raw["ids"], np.int64), "labels": np.frombuffer(raw["labels"], np.int64), "borders": np.frombuffer(raw["borders"]).reshape(dim, -1), "codes": np.frombuffer(raw["codes"], np.uint8).reshape(-1, dim), "exact": np.frombuffer(raw["exact"]).reshape(-1, dim)}
                n = len(raw["a_ids"]) // 8
                anchors = {"ids": np.frombuffer(raw["a_ids"], np.int64), "labels": np.frombuffer(raw["a_labels"], np.int64), "exact": np.frombuffer(raw["a_exact"]).reshape(n, dim), "positives": np.frombuffer(raw["a_positives"], np.int64).reshape(n, -1), "scores": np.frombuffer(raw["a_scores"]).reshape(n, -1)}
                for at in range(0, n, ROWS):
                    for columns in solve({c: v[at : at + ROWS] for c, v in anchors.items()}, block):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
        release_memory()

    return run


def _meetings(blocks: DataFrame, anchors: DataFrame, parts: int, wards: int) -> DataFrame:
    """Every block of vectors beside every block of anchors of its length: a ward of the anchors goes to each part of the blocks, a part of the blocks to each ward.

    Spark guesses the size of the copies from that of one, and would broadcast them all; so the join is a sort-merge join, which holds a ward's anchors of a part.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda ids, n: F.pmod(F.xxhash64(ids), F.lit(n)).cast("int")
    sent = anchors.select("dim", *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "exact", "positives", "scores")], dealt("ids", wards).alias("ward"), every(parts).alias("part"))
    return blocks.select("*", dealt("ids", parts).alias("part"), every(wards).alias("ward")).join(sent.hint("merge"), ["part", "ward", "dim"])


def _ranked(found: DataFrame, keys: list[str], number: str, score: str, most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), number)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _one_for_each_key(rows: DataFrame) -> DataFrame:
    """(id, label, vec) with one row for each id: of several, the smallest by label, then vector."""
    several = materialize(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    if several.isEmpty():
        return rows
    least = rows.join(several, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "vec")).alias("x")).select("id", "x.label", "x.vec")
    return rows.join(several, "id", "left_anti").unionByName(least)


def hard_negatives(df: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), scores as doubles.

    Anchors are the rows for which ``anchor`` is true. Their positives are the ``positives`` other rows of their label with the highest inner product; for each, the
    first ``negatives`` rows of other labels whose score s satisfies ``low * p <= 100 * s <= high * p`` are returned, p being the positive's score.
    Higher scores come first, ties by smaller key. Fewer rows are returned where there are fewer.

    Rows without a key or label, and vectors that are null, empty or hold null or non-finite components, take no part. Zero vectors do. Vectors of
    different lengths have no score. Of rows that share a key one counts, the smallest by label, then vector; so repeated rows count once.
    Extra columns don't matter, whatever their names. An empty table gives an empty one. Scores are exact for integers below 2^53, else those of double precision.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vec"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & fine_vector(F.col("vec")))
    asking = rows.where("asks").select("id").distinct()
    one = _one_for_each_key(rows.select("id", "label", "vec"))
    blocks = materialize(one.mapInArrow(_packed_blocks, _BLOCKS))
    asked = materialize(one.join(asking, "id", "left_semi"))
    n, size = asked.agg(F.count(F.lit(1)), F.sum(8 * F.size("vec").cast("long"))).first()
    parts, tasks, wards = max(1, min(blocks.count(), 4 * partitions(spark))), max(1, -(-n // ANCHORS)), max(1, -(-(size or 0) // ANCHOR_BYTES))

    def packed(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks).mapInArrow(_packed_anchors(positives), _ANCHORS)

    def alike(a: dict, b: dict) -> Iterator[tuple]:
        i, j, score = nearest_alike(a, b, positives)
        yield a["ids"][i], b["ids"][j], score

    def windows(a: dict, b: dict) -> Iterator[tuple]:
        for place, i, j, score in in_windows(a, b, negatives, low, high):
            yield a["ids"][i], a["positives"][i, place], a["scores"][i, place], b["ids"][j], score

    first = packed(asked.withColumn("found", F.lit(None).cast("array<struct<id:long,score:double>>")))
    near = _meetings(blocks, first, parts, wards).mapInArrow(_met(alike, ["anchor_id", "id", "score"]), "anchor_id long, id long, score double")
    best = _ranked(near, ["anchor_id"], "id", "score", positives).groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("found"))
    known = materialize(asked.hint("merge").join(best.select(F.col("anchor_id").alias("id"), F.transform("found", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("found")), "id"))
    drop_scratch(asked)
    fields = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    met = _meetings(blocks, packed(known), parts, wards).mapInArrow(_met(windows, fields), "anchor_id long, positive_id long, positive_score double, negative_id long, negative_score double")
    return _ranked(met, ["anchor_id", "positive_id"], "negative_id", "negative_score", negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all, by integer inner products, with every seventh label moved by one."""
    key = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").where(fine_vector(F.col("embedding"))).select(
        key,
        F.when(key % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double")).alias("embedding"),
    )
    found = hard_negatives(rows, key % 100 == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", F.col("positive_score").cast("long").alias("positive_score"), F.col("negative_score").cast("long").alias("negative_score"))


ORACLE_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
