"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Three passes. In how many documents of each class every hashed n-gram occurs is counted over all labelled training rows, in partial
tables that are summed by block. The n-grams whose rates differ most between the classes stay; each is scaled by its log-count
ratio, and a logistic regression over the scaled presence is fitted on a bounded sample. Then every whole text is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import draw_rows, partitions, small_batches, table

#: Characters of an n-gram, buckets they are hashed to (as a power of two), blocks of partial counts.
ORDERS, BITS, BLOCKS = (3, 4, 5, 6), 20, 64
#: N-grams that stay, labelled rows of each class that the regression is fitted on at most, its penalty and steps.
FEATURES, SAMPLE_ROWS, PENALTY, STEPS = 4000, 4000, 1e-3, 150
#: Rows of labels that are broadcast at most (about 16 bytes each); more are joined by shuffle.
MAX_BROADCAST_LABELS = 2_000_000
#: Folds of the held-out split.
FOLDS = 5


def held_out(key: Column) -> Column:
    """Whether a row is kept from training: crc32 of the key's text, mod 5, is 0. A null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def ngrams(text: str | None) -> np.ndarray:
    """The hashed character n-grams of a text in lower case with a blank at both ends, in order and with repeats."""
    data = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    rolling, out = data, []
    for n in range(2, max(ORDERS) + 1):
        if len(data) < n:
            break
        rolling = rolling[:-1] * np.uint32(0x01000193) + data[n - 1 :]
        if n in ORDERS:
            mixed = rolling + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
            out.append((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


@dataclass
class Model:
    """Weights of the kept n-grams (0 for all others) and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        found = ngrams(text)
        used = np.unique(found[self.weights[found] != 0])
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[used].sum(dtype=np.float64), -500, 500))))


def document_counts(labelled: DataFrame) -> DataFrame:
    """(block, body): for each task and block, in how many of its documents of (text, label) each n-gram occurs, by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, last = np.zeros((2, 1 << BITS), np.uint32), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                found = ngrams(text.as_py())
                at = np.arange(1, len(found) + 1)
                last[found] = at
                counts[label, found[last[found] == at]] += 1
        if counts.any():
            parts = counts.reshape(2, BLOCKS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array([zlib.compress(parts[:, b].tobytes(), 1) for b in range(BLOCKS)], pa.binary())], ["block", "body"])

    return labelled.mapInArrow(run, "block int, body binary")


def telling_ngrams(labelled: DataFrame, sizes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(number, log-count ratio) of the FEATURES n-grams whose document rates differ most between the classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body"), strict=True):
                part = np.frombuffer(zlib.decompress(body.as_py()), np.uint32).reshape(2, -1).astype(np.int64)
                sums[block] = sums[block] + part if block in sums else part
        for block, (zero, one) in sums.items():
            rate = (zero + one) / sum(sizes)
            spread = np.sqrt(np.maximum(rate * (1 - rate) * (1 / sizes[0] + 1 / sizes[1]), 1e-12))
            z = np.abs(one / sizes[1] - zero / sizes[0]) / spread
            z[zero + one == 0] = -1  # n-grams that never come rank behind those whose rates are equal
            best = np.lexsort((np.arange(len(z)), -z))[:FEATURES]
            best = best[(zero + one)[best] > 0]
            number = block * len(z) + best
            total = np.full(len(best) + 1, -1.0)
            total[1:] = z[best]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], number])), pa.array(total), pa.array(np.concatenate([[zero.sum()], zero[best]])), pa.array(np.concatenate([[one.sum()], one[best]]))], ["number", "z", "zero", "one"])

    dealt = document_counts(labelled).repartition(min(BLOCKS, partitions(labelled.sparkSession)), "block")
    rows = dealt.mapInArrow(run, "number long, z double, zero long, one long").cache()
    totals = rows.where("number < 0").agg(F.sum("zero"), F.sum("one")).first()
    best = rows.where("number >= 0").orderBy(F.desc("z"), "number").limit(FEATURES).collect()
    rows.unpersist()
    number = np.asarray([r["number"] for r in best], np.int64)
    zero, one = (np.asarray([r[n] for r in best], np.float64) for n in ("zero", "one"))
    ratio = np.log((one + 1) / ((totals[1] or 0) + (1 << BITS))) - np.log((zero + 1) / ((totals[0] or 0) + (1 << BITS)))
    return number, ratio


def logistic_regression(feature: np.ndarray, row: np.ndarray, value: np.ndarray, label: np.ndarray, weight: np.ndarray, features: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge-penalised logistic regression on sparse rows, by Adam over all rows at each step."""
    w, b = np.zeros(features + 1), 0.0
    first, second = np.zeros(features + 1), np.zeros(features + 1)
    weight = weight / weight.sum()
    for step in range(1, STEPS + 1):
        u = b + np.bincount(row, w[feature] * value, len(label))
        off = (1 / (1 + np.exp(-np.clip(u, -500, 500))) - label) * weight
        slope = np.append(np.bincount(feature, off[row] * value, features) + PENALTY * w[:-1], off.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        move = 0.05 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w[:-1] -= move[:-1]
        b -= move[-1]
    return w[:-1], b


def fit(labelled: DataFrame) -> Model:
    """A model from (id, text, label 0 or 1). With rows of one class or none, every score is that class's smoothed rate (0.5 for none).

    The counts are of all rows; the regression sees at most about SAMPLE_ROWS of each class, those with small hashes of their id.
    """
    small_batches(labelled.sparkSession)
    found = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = found.get(0, 0), found.get(1, 0)
    if not all(sizes):
        rate = (sizes[1] + 1) / (sum(sizes) + 2)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(rate / (1 - rate))))
    number, ratio = telling_ngrams(labelled, sizes)
    place = np.full(1 << BITS, -1, np.int32)
    place[number] = np.arange(len(number))
    shared = labelled.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [np.unique(x[x >= 0]).astype("<i4").tobytes() for x in (shared.value[ngrams(t.as_py())] for t in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(kept, pa.binary())], ["id", "label", "body"])

    drawn = draw_rows(labelled, "label", found, SAMPLE_ROWS).select("id", "text", "label")
    rows = drawn.mapInArrow(run, "id long, label int, body binary").collect()
    rows.sort(key=lambda r: (r["id"], r["label"], bytes(r["body"])))
    lists = [np.frombuffer(r["body"], "<i4") for r in rows]
    label = np.asarray([r["label"] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(x) for x in lists])
    feature = np.concatenate([np.empty(0, np.int32), *lists])
    weight = np.asarray(sizes)[label] / np.bincount(label, minlength=2)[label]
    w, b = logistic_regression(feature, row, ratio[feature], label, weight, len(number))
    weights = np.zeros(1 << BITS, np.float32)
    weights[number] = w * ratio
    return Model(weights, float(b))


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(id, text, label) of the rows of ``docs`` with a non-null label that aren't held out; with several labels, 1 counts."""
    marked = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label")).where("_key is not null and label in (0, 1)").groupBy("_key").agg(F.max("label").alias("label"))
    if labels.count() <= MAX_BROADCAST_LABELS:
        marked = F.broadcast(marked)
    rows = docs.select(F.col(key).alias("_key"), "text").where(~held_out(F.col("_key")))
    return rows.join(marked, "_key").select(F.col("_key").cast("long").alias("id"), "text", "label")


def score_texts(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """Every row with a score from 0 to 1 for its text; a null text is an empty one. An input column of the name is replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop(out)
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, from a model that hasn't seen the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(training_rows(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    scored = score_texts(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
