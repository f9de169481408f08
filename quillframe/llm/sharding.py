"""Sharding by weighted rendezvous hashing of a stable record key [native].

Every (record, shard) pair gets a uniform number u from an MD5 of the key and the shard; the shard with the least
-ln(u) / weight takes the record. A record's shard depends on its key and the weighted shards alone, so a new shard
takes records only into itself, in proportion to its weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gapless_rank, table

#: Parts that the rows of a shard are numbered in; shards x BUCKETS rows are broadcast (24 x 256 rows of 24 bytes).
BUCKETS = 256
MAX_BROADCAST_ROWS = 1_000_000
SHARDS = 24


def _unit(text: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of a text."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def _name(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) of a key. A null key counts as the empty text; ties go to the smaller shard."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    races = [F.struct((-F.ln(_unit(F.concat(_name(key), F.lit(f":{i}")))) / F.lit(float(w))).alias("t"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.array_min(F.array(*races))["shard"].cast("int")


def shard_records(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Add ``shard``, ``slot`` (gapless from 0 in each shard) and, with ``grown`` weights, ``grown_shard``.

    All input columns stay (a column named as one of the added ones is replaced). Repeated rows each get a slot of
    their own; rows of one key are numbered in any order. An empty table gives an empty result.
    """
    if len(weights) * buckets > MAX_BROADCAST_ROWS:
        raise ValueError("too many shards for this number of buckets")
    df = df.drop("shard", "slot", "grown_shard")
    bucket = F.conv(F.substring(F.md5(_name(F.col(key)).cast("binary")), 1, 8), 16, 10).cast("long") % buckets
    counted = df.select(key).withColumn("shard", rendezvous(F.col(key), weights))
    placed = df.withColumn("shard", rendezvous(F.col(key), weights))
    if grown is not None:
        placed = placed.withColumn("grown_shard", rendezvous(F.col(key), grown))
    return gapless_rank(placed, counted, ["shard"], bucket, [F.col(key)], buckets, "slot")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 equal shards, by the law ``key``. A null text has size 8 and CRC 0."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = shard_records(docs, "doc_id", [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


_RACE = "list_min(list_transform(range(0, {n}), lambda i: {{'t': -ln((('0x' || substr(md5(doc_id::VARCHAR || ':' || i::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0), 's': i}})).s::INTEGER"

#: The CRC is computed byte by byte from its polynomial.
ORACLE_SQL = f"""
WITH steps AS (
  SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b::BIGINT, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table
), d AS (
  SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents
), e AS (
  SELECT doc_id, text, strlen(text)::BIGINT AS n, list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])) AS c FROM d, steps
), p AS (
  SELECT doc_id, n + 8 AS size, xor(c, 4294967295)::BIGINT AS text_crc32, {_RACE.format(n=SHARDS)} AS shard, {_RACE.format(n=SHARDS + 1)} AS grown_shard,
    ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {BUCKETS} AS bucket FROM e
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id) - 1)::BIGINT AS slot, grown_shard FROM p
"""
