"""Packing documents into fixed windows of tokens by minimum bin slack.

A document is cut into whole windows and one remainder. Only the number of remainders of each length (at most
``window`` - 1 numbers, however many documents there are) goes to the driver, which plans the windows: for the longest
length left, a bitset subset-sum finds the multiset of remaining lengths that fills a window closest to its capacity,
backtracking gives its counts, and the window is repeated as often as the stock allows. Each remainder then finds its
window from its length and its gapless rank among the remainders of that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import gapless_rank, materialize, partitions, private, small_batches, table

WINDOW, END = 2048, 1
#: Parts that the pieces of one length are numbered in. A length that holds HOT of all pieces, as whole windows do, has as many as there are tasks, SPREAD for each,
#: if that leaves LEAST_ROWS in a part. So at most window x BUCKETS + SPREAD / HOT x tasks rows of 24 bytes are broadcast.
BUCKETS, HOT, SPREAD, LEAST_ROWS = 64, 1 / 8, 8, 64


@dataclass
class Plan:
    """Ranges of ranks: remainders of ``length`` ranked from ``rank`` fill ``each`` places of each window from ``sequence`` on, from ``offset``."""

    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    windows: int = 0


def fill(stock: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of stocked lengths (length -> count) with the largest sum up to ``capacity``.

    Longer lengths come first and no more lots are tried once the capacity is met, which saves short ones for later.

    Bit s of ``reached[k]`` says that the first k lots can sum to s. A length's stock is split into lots of 1, 2, 4, ...
    pieces, so a length takes a logarithmic number of shifts.
    """
    mask = (1 << (capacity + 1)) - 1
    lots, reached = [], [1]
    for length in sorted(stock, reverse=True):
        left, lot = min(stock[length], capacity // length), 1
        while left:
            lot = min(lot, left)
            lots.append((length, lot))
            reached.append(reached[-1] | reached[-1] << length * lot & mask)
            left, lot = left - lot, lot * 2
        if reached[-1] >> capacity & 1:
            break
    total, counts = reached[-1].bit_length() - 1, {}
    for k in range(len(lots), 0, -1):
        if not reached[k - 1] >> total & 1:
            length, lot = lots[k - 1]
            counts[length] = counts.get(length, 0) + lot
            total -= length * lot
    return counts


def plan_windows(histogram: dict[int, int], window: int = WINDOW, first: int = 0) -> Plan:
    """Windows for a stock of remainders; each step uses up at least one length's stock down to less than the window needs."""
    stock = {length: n for length, n in histogram.items() if n > 0}
    used = dict.fromkeys(stock, 0)
    plan, sequence = Plan(), first
    while stock:
        longest = max(stock)
        rest = dict(stock)
        rest[longest] -= 1
        counts = fill({x: n for x, n in rest.items() if n and x <= window - longest}, window - longest)
        counts[longest] = counts.get(longest, 0) + 1
        times, offset = min(stock[x] // n for x, n in counts.items()), 0
        for length, each in sorted(counts.items(), reverse=True):
            for name, value in (("length", length), ("rank", used[length]), ("sequence", sequence), ("each", each), ("offset", offset)):
                getattr(plan, name).append(value)
            used[length] += each * times
            stock[length] -= each * times
            offset += each * length
            if not stock[length]:
                del stock[length]
        sequence += times
    plan.windows = sequence - first
    return plan


def cut_pieces(docs: DataFrame, key: str, path: str, window: int = WINDOW, end: int = END, text: str = "text") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens): every document's ids with the end id, in whole windows and a remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, mark = bpe.load(path, library=True), end.to_bytes(4, "little")
        for whole in batches:
            for at in range(0, whole.num_rows, bpe.BATCH_ROWS):
                batch, rows = whole.slice(at, bpe.BATCH_ROWS), []
                for i, t in enumerate(batch.column("text")):
                    ids = tokenizer.encode(t.as_py() or "") + mark
                    n = len(ids) // 4
                    rows += [(i, s, min(window, n - s), zlib.crc32(ids[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], [key, "start", "length", "ids_crc32", "doc_tokens"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add ``sequence_id`` (gapless from 0) and ``offset`` to pieces of at most ``window`` tokens.

    ``pieces`` must be a stored table: it is read for the histogram, the ranks and the result. Its columns stay, but
    for input columns of the added names. Equal pieces take any of their places. An empty table stays empty.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    rank, order = private(pieces, "_rank"), [F.col(f"`{c}`") for c in pieces.columns]
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = F.lit(BUCKETS)
    for x, n in histogram.items():
        if n >= HOT * sum(histogram.values()):
            parts = F.when(F.col("length") == x, max(BUCKETS, min(n // LEAST_ROWS, SPREAD * partitions(spark)))).otherwise(parts)
    ranked = gapless_rank(pieces, pieces, ["length"], F.pmod(F.xxhash64(*order), parts), order, BUCKETS, rank)
    whole = histogram.pop(window, 0)
    plan = plan_windows(histogram, window, first=whole)
    ranges = spark.sparkContext.broadcast({name: np.asarray(getattr(plan, name), np.int64) for name in ("length", "rank", "sequence", "each", "offset")})
    names = pieces.columns

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ranges.value
        order = np.lexsort((found["rank"], found["length"]))
        steps = {k: v[order] for k, v in found.items()}
        begin = np.searchsorted(steps["length"], np.arange(window + 2))
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            place = batch.column(rank).to_numpy(zero_copy_only=False)
            sequence, offset = place.copy(), np.zeros_like(place)
            for x in np.unique(length[length < window]):
                mine = np.flatnonzero(length == x)
                lo, hi = begin[x], begin[x + 1]
                at = lo + np.searchsorted(steps["rank"][lo:hi], place[mine], side="right") - 1
                inside = place[mine] - steps["rank"][at]
                sequence[mine] = steps["sequence"][at] + inside // steps["each"][at]
                offset[mine] = steps["offset"][at] + inside % steps["each"][at] * x
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(placed, T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """The pieces of all documents with their places. A null text is an empty one: its only id is the end id.

    Repeated rows are packed each, a null key stays null, other columns don't matter, and an empty table gives an empty one.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return pack(materialize(cut_pieces(docs, "doc_id", path, window)), window)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
