"""Language identification with error-correcting output codes.

Every language has a codeword of signs. For each bit, a ridge classifier over hashed byte n-grams predicts on which side a text lies. The
decoder adds up, for each language, the logistic losses of its codeword against the predicted bits, each bit weighted by how
reliable it was on left-out training rows; the least loss wins, and a narrow win is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import draw_rows, small_batches, table
from .toxicity import held_out

#: Bytes of an n-gram and buckets for each length.
ORDERS, BUCKETS = (1, 2, 3, 4), 2048
#: Labelled rows that the classifiers are fitted on at most, and of one language at least if there are as many.
SAMPLE_ROWS, LEAST_ROWS = 1500, 20
#: Ridge penalty, bits of a random code for each doubling of the languages, score under which a decision is ambiguous.
PENALTY, BITS_PER_DOUBLING, AMBIGUOUS = 1e-3, 10, 0.5
NONE = "und"


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def features(text: str | None) -> np.ndarray:
    """Square roots of n-gram rates by length, as one vector of length 1; zeros for an empty text."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    out = np.zeros((len(ORDERS), BUCKETS), np.float32)
    rolling = data
    for k, n in enumerate(ORDERS):
        if len(data) < n:
            break
        if n > 1:
            rolling = rolling[:-1] * np.uint32(0x01000193) + data[n - 1 :]
        mixed = (rolling ^ (rolling >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[k] = np.sqrt(np.bincount(mixed >> np.uint32(21), minlength=BUCKETS) / len(mixed))
    flat = out.reshape(-1)
    return flat / (np.linalg.norm(flat) or 1)


def codewords(languages: int) -> np.ndarray:
    """A row of signs for each language: all splits in two for up to five languages, else the random code of many with the largest least distance."""
    if languages <= 5:
        splits = np.arange(1, 1 << max(0, languages - 1))
        return np.where(splits >> np.arange(languages)[:, None] & 1, 1, -1)
    bits = int(np.ceil(BITS_PER_DOUBLING * np.log2(languages)))
    draw, best, least = np.random.default_rng(languages), None, -1
    for _ in range(50):
        code = np.where(draw.random((languages, bits)) < 0.5, 1, -1)
        if (np.abs(code.sum(axis=0)) == languages).any():
            continue
        apart = int(((bits - code @ code.T) // 2 + bits * np.eye(languages, dtype=int)).min())
        if apart > least:
            best, least = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    reliability: np.ndarray
    sharpness: float

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted loss of every language for rows of bit margins."""
        return np.stack([np.logaddexp(0, -2 * margins * word) @ self.reliability for word in self.code], axis=1)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest codeword (ties to the first) and its share of exp(-sharpness x loss)."""
        losses = self.losses(margins)
        share = np.exp(-self.sharpness * (losses - losses.min(axis=1, keepdims=True)))
        return losses.argmin(axis=1), share.max(axis=1) / share.sum(axis=1)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        lettered = [i for i, t in enumerate(texts) if has_letter(t)]
        out = [(NONE, 0.0)] * len(texts)
        if lettered and self.languages:
            x = np.stack([features(texts[i]) for i in lettered])
            best, score = self.decode(x @ self.weights + self.bias) if len(self.languages) > 1 else (np.zeros(len(x), int), np.ones(len(x)))
            for i, b, s in zip(lettered, best, score, strict=True):
                out[i] = self.languages[b], float(s)
        return out


def fit_rows(x: np.ndarray, language: list[str]) -> Model:
    """Ridge classifiers for all bits at once, in the dual; left-out predictions come in closed form."""
    languages = sorted(set(language))
    code = codewords(len(languages))
    number = np.asarray([languages.index(v) for v in language], int)
    if len(languages) < 2:
        return Model(languages, code, np.zeros((x.shape[1], code.shape[1])), np.zeros(code.shape[1]), np.ones(code.shape[1]), 1.0)
    target = code[number].astype(np.float64)
    share = np.bincount(number)[number]
    bias = np.average(target, axis=0, weights=1 / share)
    gram = (x @ x.T).astype(np.float64)
    gram[np.diag_indices_from(gram)] += PENALTY * len(x) / 10
    inverse = np.linalg.inv(gram)
    dual = inverse @ (target - bias)
    left_out = target - dual / np.diag(inverse)[:, None]
    wrong = np.clip((left_out * target <= 0).mean(axis=0), 1e-3, 0.5)
    reliability = np.log((1 - wrong) / wrong) + 1e-6
    model = Model(languages, code, (x.T @ dual.astype(np.float32)).astype(np.float32), bias.astype(np.float32), reliability / reliability.sum() * code.shape[1], 1.0)
    losses = model.losses(left_out)

    def surprise(sharpness: float) -> float:
        scaled = -sharpness * losses
        return float((np.logaddexp.reduce(scaled, axis=1) - scaled[np.arange(len(x)), number]).mean())

    model.sharpness = min((0.25, 0.5, 1.0, 2.0, 4.0, 8.0), key=surprise)
    return model


def fit(docs: DataFrame) -> Model:
    """A model from (id, text, lang): rows with a null lang or text without a letter don't count; of each language, rows with small id hashes are taken."""
    small_batches(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return fit_rows(np.zeros((0, len(ORDERS) * BUCKETS), np.float32), [])
    drawn = draw_rows(labelled, "lang", sizes, max(LEAST_ROWS, SAMPLE_ROWS // len(sizes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = [features(t.as_py()).astype("<f2").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), pa.array(body, pa.binary())], ["id", "lang", "body"])

    rows = drawn.select("id", "lang", "text").mapInArrow(run, "id long, lang string, body binary").collect()
    rows.sort(key=lambda r: (r["id"], r["lang"], bytes(r["body"])))
    x = np.stack([np.frombuffer(r["body"], "<f2") for r in rows]).astype(np.float32) if rows else np.zeros((0, len(ORDERS) * BUCKETS), np.float32)
    return fit_rows(x, [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Every row with ``lang_pred`` (``und`` for a null text or one without a letter), ``score`` and ``ambiguous``; input columns of these names are replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "ambiguous")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = shared.value.predict([t.as_py() for t in part.column("text")])
                new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[1] < AMBIGUOUS for f in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*names, "lang_pred", "score", "ambiguous"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("id"), "text", "lang")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, from a model that hasn't seen the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(training_rows(docs))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
