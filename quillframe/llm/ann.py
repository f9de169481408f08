"""Approximate nearest neighbours by inner product, from balanced posting lists.

Centroids come from a balanced k-means of two levels on a bounded sample; every vector of the table is then indexed. A vector joins
the list of its nearest centroid and, near a boundary, those of others almost as near. Centroids are searched by an in-memory neighbour
graph. A query takes the lists whose centroids are within a ratio of the nearest one's distance, and no more than a number of lists; ratio
and number are what a bounded set of trial queries needs to find its exact neighbours, so recall doesn't fall as lists become many, and
the work for a query grows with the table just as far as its neighbours are spread. The largest inner product is found as the smallest
distance after one more dimension makes all vectors equally long.

Long lists are cut into cells of bounded size; a query meets each cell of its lists, and keeps its best of each. Scores are sums in
double precision over the original vectors, in order of dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, matrix, partitions, splitmix, table, usable

TOP, QUERY_STEP = 20, 20
#: Vectors of a list on average, lists at most (9 MB of centroids; beyond 6.5 million vectors lists grow and are cut into more cells), vectors of a cell.
LIST_SIZE, MAX_LISTS, CELL = 400, 16_384, 4096
#: Rows that the centroids are fitted on, at most (40 a list if that is less).
SAMPLE_ROWS = 65_536
#: Lists of a vector at most and how much farther than the nearest they may be; lists that a query opens anyway.
REPLICAS, REPLICA_RATIO, LEAST_PROBES = 4, 1.10, 8
#: Queries compared with all vectors at most, and the share of their exact neighbours that the lists opened must hold.
TRIALS, TARGET = 128, 0.98
#: Neighbours of a centroid in the graph.
DEGREE = 24


@dataclass
class Index:
    """Centroids in the lengthened space and their neighbour graph; ``longest`` is the greatest length of a vector."""

    centroids: np.ndarray
    graph: np.ndarray
    longest: float

    def lengthened(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.longest**2 - np.einsum("ij,ij->i", x, x)))
        return np.concatenate([x, extra[:, None]], axis=1)

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest ``width`` centroids of each row and their distances, nearest first, by best-first walks over the graph for all rows at once."""
        n, total = len(x), len(self.centroids)
        width = min(width, total)
        norms = np.einsum("ij,ij->i", self.centroids, self.centroids)
        square = np.einsum("ij,ij->i", x, x)

        def away(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
            return np.maximum(0, norms[to] - 2 * np.einsum("nkd,nd->nk", self.centroids[to], x[rows]) + square[rows][:, None])

        start = np.unique(np.linspace(0, total - 1, min(total, 8)).astype(int))
        seen = np.zeros((n, total), bool)
        seen[:, start] = True
        everyone = np.arange(n)
        ids = np.full((n, width + DEGREE), -1)
        dist = np.full((n, width + DEGREE), np.inf)
        done = np.ones((n, width + DEGREE), bool)
        k = min(len(start), width)
        first = away(everyone, np.broadcast_to(start, (n, len(start))))
        order = np.argsort(first, axis=1)[:, :k]
        ids[:, :k], dist[:, :k], done[:, :k] = start[order], np.take_along_axis(first, order, 1), False
        while True:
            waiting = np.where(done[:, :width], np.inf, dist[:, :width])
            rows = np.flatnonzero(np.isfinite(waiting.min(axis=1)))
            if not len(rows):
                return ids[:, :width], np.sqrt(dist[:, :width])
            at = waiting[rows].argmin(axis=1)
            done[rows, at] = True
            near = self.graph[ids[rows, at]]
            fresh = ~seen[rows[:, None], near]
            seen[rows[:, None], near] = True
            d = np.where(fresh, away(rows, near), np.inf)
            ids[rows, width : width + near.shape[1]], dist[rows, width : width + near.shape[1]], done[rows, width : width + near.shape[1]] = near, d, ~fresh
            order = np.argsort(dist[rows], axis=1, kind="stable")
            for state in (ids, dist, done):
                state[rows] = np.take_along_axis(state[rows], order, 1)
            dist[rows, width:] = np.inf
            done[rows, width:] = True

    def nearest(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``search``; where a walk would see most centroids anyway, all are compared at once."""
        if width * DEGREE < len(self.centroids):
            return self.search(x, width)
        square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", self.centroids, self.centroids) - 2 * x @ self.centroids.T
        found = np.argsort(square, axis=1, kind="stable")[:, :width]
        return found, np.sqrt(np.maximum(0, np.take_along_axis(square, found, 1)))

    def lists(self, x: np.ndarray, most: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: the lists within ``ratio`` of the nearest one's distance, ``most`` at most."""
        found, dist = self.search(x, most)
        row, place = np.nonzero(dist <= dist[:, :1] * ratio + 1e-12)
        return row, found[row, place]


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """k-means whose distances grow with the size of a cluster, so that clusters become even."""
    centroids = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    price = np.zeros(lists)
    scale = float(np.var(x, axis=0).sum()) or 1.0
    for _ in range(rounds):
        near = np.empty(len(x), np.int64)
        cost = np.einsum("ij,ij->i", centroids, centroids) + price
        for at in range(0, len(x), 2048):
            near[at : at + 2048] = (cost - 2 * x[at : at + 2048] @ centroids.T).argmin(axis=1)
        size = np.bincount(near, minlength=lists)
        order = np.argsort(near, kind="stable")
        full = size > 0
        sums = np.add.reduceat(x[order], (np.cumsum(size) - size)[full], axis=0)
        centroids[full] = sums / size[full][:, None]
        price += 0.02 * scale * (size / size.mean() - 1)
    return centroids


def two_level_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Balanced clusters of the sample, each cut into balanced lists in proportion to its rows: the work grows with lists^1.5, not their square."""
    if lists <= 64:
        return balanced_centroids(x, lists)
    upper = balanced_centroids(x, int(lists**0.5))
    norms = np.einsum("ij,ij->i", upper, upper)
    near = np.concatenate([(norms - 2 * x[at : at + 2048] @ upper.T).argmin(axis=1) for at in range(0, len(x), 2048)])
    size = np.bincount(near, minlength=len(upper))
    ends = np.round(np.cumsum(size) / len(x) * lists).astype(int)
    share = np.minimum(np.diff(np.concatenate([[0], ends])), size)
    return np.concatenate([balanced_centroids(x[near == k], n) for k, n in enumerate(share) if n])


def neighbour_graph(centroids: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """The nearest centroids of each, and one link in a ring through all, so that every centroid can be reached; no link comes twice."""
    n = len(centroids)
    ring = (np.arange(n) + 1) % n
    near = np.empty((n, min(degree, n) - 1 if n > 1 else 0), np.int64)
    norms = np.einsum("ij,ij->i", centroids, centroids)
    for at in range(0, n, 1024):
        d = norms - 2 * centroids[at : at + 1024] @ centroids.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = -np.inf
        first = np.argpartition(d, near.shape[1], axis=1)[:, : near.shape[1] + 1]
        order = np.argsort(np.take_along_axis(d, first, 1), axis=1, kind="stable")
        near[at : at + 1024] = np.take_along_axis(first, order, 1)[:, 1:]
    known = (near == ring[:, None]).any(axis=1)
    return np.concatenate([near, np.where(known, np.arange(n), ring)[:, None]], axis=1)


def fit(vectors: DataFrame, count: int, longest: float) -> Index:
    """An index over (id, vec): the sample is the rows of the smallest id hashes, so it doesn't depend on the layout of the table."""
    lists = int(min(MAX_LISTS, max(1, count // LIST_SIZE)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in matrix(batch.column("vec")).astype("<f4")], pa.binary())], ["body"])

    drawn = vectors.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE_ROWS, 40 * lists + 20)).select("vec")
    rows = [np.frombuffer(r["body"], "<f4") for r in drawn.mapInArrow(packed, "body binary").collect()]
    index = Index(np.empty((0, 0)), np.empty((0, 0)), float(np.sqrt(longest)))
    sample = index.lengthened(np.stack(rows).astype(np.float64))
    index.centroids = two_level_centroids(sample, min(lists, len(sample)))
    index.graph = neighbour_graph(index.centroids)
    return index


def fitted_probes(indexed: DataFrame, is_query: str, opened: Index, full: np.ndarray, dim: int, top: int) -> tuple[int, float]:
    """(lists, ratio) that hold TARGET of the exact neighbours of trial queries, those of the smallest id hashes; lists ``full`` can be opened.

    Every task keeps the best of its rows of (id, vec, lists) for each trial and tells only how near a neighbour's nearest list is.
    """
    if len(full) <= LEAST_PROBES:
        return LEAST_PROBES, np.inf
    trials = indexed.where(is_query).where(F.size("vec") == dim).orderBy(F.xxhash64("id", F.lit("trial")), "id").limit(TRIALS).select("id", "vec").toPandas()
    if not len(trials):
        return LEAST_PROBES, np.inf
    asking, q = trials["id"].to_numpy(), np.asarray(trials["vec"].tolist(), np.float64)
    order, away = opened.nearest(opened.lengthened(q, query=True), len(full))
    place, far = np.full((len(q), full.max() + 1), len(full)), np.full((len(q), full.max() + 1), np.inf)
    np.put_along_axis(place, full[order], np.broadcast_to(np.arange(len(full)), order.shape), 1)
    np.put_along_axis(far, full[order], away / np.maximum(away[:, :1], 1e-300), 1)
    shared = indexed.sparkSession.sparkContext.broadcast((asking, q, place, far))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, q, place, far = shared.value
        ids, score, nearest, ratio = np.empty((len(q), 0), np.int64), np.empty((len(q), 0)), np.empty((len(q), 0), np.int64), np.empty((len(q), 0))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                key, x = part.column("id").to_numpy(zero_copy_only=False), matrix(part.column("vec"))
                new = np.where(asking[:, None] == key, -np.inf, q @ x.T)
                mine = np.argsort(-new, axis=1, kind="stable")[:, :top]
                owner, number = np.repeat(np.arange(len(key)), part.column("lists").value_lengths().to_numpy(zero_copy_only=False)), part.column("lists").flatten().to_numpy(zero_copy_only=False)
                held = np.full((len(key), REPLICAS), number[0] if len(number) else 0)
                begin = np.searchsorted(owner, np.arange(len(key)))
                held[:] = number[begin][:, None]
                held[owner, np.arange(len(owner)) - begin[owner]] = number
                in_lists, rows = held[mine], np.arange(len(q))[:, None, None]
                ids, score = np.concatenate([ids, key[mine]], axis=1), np.concatenate([score, np.take_along_axis(new, mine, 1)], axis=1)
                nearest = np.concatenate([nearest, place[rows, in_lists].min(axis=2)], axis=1)
                ratio = np.concatenate([ratio, far[rows, in_lists].min(axis=2)], axis=1)
                keep = np.argsort(-score, axis=1, kind="stable")[:, :top]
                ids, score, nearest, ratio = (np.take_along_axis(c, keep, 1) for c in (ids, score, nearest, ratio))
        fine = np.isfinite(score.reshape(-1))
        if fine.any():
            trial = np.repeat(np.arange(len(q)), ids.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(c[fine]) for c in (trial, ids.reshape(-1), score.reshape(-1), nearest.reshape(-1), ratio.reshape(-1))], ["trial", "id", "score", "place", "ratio"])

    best = Window.partitionBy("trial").orderBy(F.desc("score"), "id")
    seen = indexed.where(F.size("vec") == dim).mapInArrow(run, "trial long, id long, score double, place long, ratio double")
    found = seen.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top).select("place", "ratio").collect()  # TRIALS * top rows
    shared.destroy()
    if not found:
        return LEAST_PROBES, np.inf
    at = int(np.ceil((1 + TARGET) / 2 * len(found))) - 1  # each bound loses half of what may be lost
    return max(LEAST_PROBES, int(np.sort([r["place"] for r in found])[at]) + 1), float(np.sort([r["ratio"] for r in found])[at]) + 1e-9


def _exact(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in order of dimension, so that equal vectors get equal scores."""
    out = np.zeros(len(q))
    for k in range(q.shape[1]):
        out += q[:, k] * m[:, k]
    return out


def _best(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, q: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each query's best members, ties to smaller ids."""
    rough = q @ x.T
    rough[queries[:, None] == ids] = -np.inf
    k = min(top, len(ids))
    edge = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k]
    slack = 1e-9 * (np.abs(x).max() * np.abs(q).max() * x.shape[1] + 1e-300)
    row, col = np.nonzero((rough >= edge[:, None] - slack) & np.isfinite(rough))
    score = _exact(q[row], x[col])
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    begin = np.searchsorted(row, np.arange(len(queries) + 1))
    for i, query in enumerate(queries):
        s = slice(begin[i], min(begin[i] + top, begin[i + 1]))
        if begin[i] < begin[i + 1]:
            yield int(query), ids[col[s]], score[s]


def _search_cells(top: int):
    """Rows come by cell, members before queries; members of a cell are held, queries pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, x, x_parts = None, [], None, []
        for batch in batches:
            cell, query, key = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "query", "id"))
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (query[1:] != query[:-1])) + 1
            out = []
            for lo, hi in zip([0, *cuts], [*cuts, len(cell)], strict=True):
                if lo == hi:
                    continue
                if cell[lo] != at:
                    at, ids, x_parts, x = cell[lo], [], [], None
                vec = matrix(batch.column("vec").slice(lo, hi - lo))  # of one length in a cell
                if not query[lo]:
                    ids.append(key[lo:hi])
                    x_parts.append(vec)
                elif ids:
                    if x is None:
                        members, x = np.concatenate(ids), np.concatenate(x_parts)
                    for s in range(lo, hi, 512):
                        out += _best(members, x, key[s : min(hi, s + 512)], vec[s - lo : s - lo + 512], top)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.float64()))], ["query_id", "ids", "scores"])

    return run


def _merge(top: int):
    """Rows come by query: the best of all its cells."""

    def close(query: int, ids: list, scores: list) -> list[tuple]:
        found, first = np.unique(np.concatenate(ids), return_index=True)
        score = np.concatenate(scores)[first]
        order = np.lexsort((found, -score))[:top]
        return [(query, r + 1, int(found[o]), float(score[o])) for r, o in enumerate(order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["query_id", "rank", "vec_id", "score"])

        at, ids, scores = None, [], []
        for batch in batches:
            rows = []
            for query, i, s in zip(batch.column("query_id").to_pylist(), batch.column("ids"), batch.column("scores"), strict=True):
                if query != at and ids:
                    rows += close(at, ids, scores)
                    ids, scores = [], []
                at = query
                ids.append(i.values.to_numpy())
                scores.append(s.values.to_numpy())
            yield emit(rows)
        if ids:
            yield emit(close(at, ids, scores))

    return run


def nearest(df: DataFrame, is_query: str, key: str = "vec_id", vector: str = "embedding", top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found of each row that ``is_query`` (SQL on the id ``id``) picks, against all other rows.

    Unusable vectors and rows without a key take no part. Vectors of different lengths aren't compared; the index is of the most frequent
    length, and those of any other are searched in full. Repeated rows of a key count once, as the smallest vector. Lists that no vector
    joined are left out, and a query opens lists until they hold more than ``top`` vectors. An empty table gives an empty result.
    """
    spark = df.sparkSession
    vectors = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec")).where(usable(F.col("vec")) & F.col("id").isNotNull())
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    main = vectors.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("longest")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not main:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = main[0]["d"]
    index = fit(vectors.where(F.size("vec") == dim), main[0]["n"], main[0]["longest"])
    shared = spark.sparkContext.broadcast(index)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists of each vector; those of another length are in one list, numbered by the negative length."""
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lengths = part.column("vec").value_lengths().to_numpy(zero_copy_only=False)
                same = np.flatnonzero(lengths == dim)
                row, number = np.arange(len(lengths)), -lengths.astype(np.int64)
                if len(same):
                    near, found = shared.value.lists(shared.value.lengthened(matrix(part.column("vec").take(pa.array(same)))), REPLICAS, REPLICA_RATIO)
                    row, number = np.concatenate([row[lengths != dim], same[near]]), np.concatenate([number[lengths != dim], found])
                    order = np.argsort(row, kind="stable")
                    row, number = row[order], number[order]
                offsets = np.searchsorted(row, np.arange(len(lengths) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vec"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(number.astype(np.int64)))], ["id", "vec", "lists"])

    kind = vectors.schema["vec"].dataType.simpleString()
    indexed = materialize(vectors.groupBy("id").agg(F.min("vec").alias("vec")).mapInArrow(joined, f"id long, vec {kind}, lists array<long>"))
    members = indexed.select(F.explode("lists").alias("list"), "id", "vec")
    sizes = {r["list"]: r["n"] for r in members.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number a list or length
    size = np.asarray([sizes.get(i, 0) for i in range(len(index.centroids))])
    full = np.flatnonzero(size)
    opened = Index(index.centroids[full], neighbour_graph(index.centroids[full]), index.longest)
    most, ratio = fitted_probes(indexed, is_query, opened, full, dim, top)
    probed = spark.sparkContext.broadcast((opened, full, size))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, full, size = probed.value
        for batch in batches:
            step = max(1, 32_768 // most)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lengths = part.column("vec").value_lengths().to_numpy(zero_copy_only=False)
                same = np.flatnonzero(lengths == dim)
                row, number = np.flatnonzero(lengths != dim), -lengths[lengths != dim].astype(np.int64)
                if len(same):
                    found, dist = graph.nearest(graph.lengthened(matrix(part.column("vec").take(pa.array(same))), query=True), max(most, 2 * top))
                    held = np.cumsum(size[full[found]], axis=1) - size[full[found]]
                    place = np.arange(found.shape[1])
                    near, place = np.nonzero((place < most) & (dist <= dist[:, :1] * ratio) | (place < LEAST_PROBES) | (held <= REPLICAS * (top + 1)))
                    row, number = np.concatenate([row, same[near]]), np.concatenate([number, full[found[near, place]]])
                yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int64)), part.column("id").take(pa.array(row)), part.column("vec").take(pa.array(row))], ["list", "id", "vec"])

    def to_cells(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                number = batch.column("list").to_numpy(zero_copy_only=False)
                row, n = np.arange(len(number)), np.asarray([-(-sizes.get(x, 1) // CELL) for x in number.tolist()], np.int64)
                if query:
                    row = np.repeat(row, n)
                    block = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                else:
                    block = (splitmix(batch.column("id").to_numpy(zero_copy_only=False)) % n.astype(np.uint64)).astype(np.int64)
                cell = number[row] << 32 | block
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(row), query)), batch.column("id").take(pa.array(row)), batch.column("vec").take(pa.array(row))], ["cell", "query", "id", "vec"])

        return run

    in_cell = f"cell long, query boolean, id long, vec {kind}"
    queries = indexed.where(is_query).select("id", "vec").mapInArrow(asked, f"list long, id long, vec {kind}")
    rows = members.mapInArrow(to_cells(False), in_cell).union(queries.mapInArrow(to_cells(True), in_cell))
    n = partitions(spark)
    found = rows.repartition(n, "cell").sortWithinPartitions("cell", "query").mapInArrow(_search_cells(top), "query_id long, ids array<long>, scores array<double>")
    return found.repartition(n, "query_id").sortWithinPartitions("query_id").mapInArrow(_merge(top), "query_id long, rank int, vec_id long, score double")


def op4_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20, among all others."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), f"id % {QUERY_STEP} = 0")


#: With few vectors all lists are opened and the result is the exact one.
ORACLE_SQL = """
WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM u q JOIN u c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
