"""Snapshots: a table by key into which batches are inserted where a key is absent, whole or not at all.

A batch is written beside the table and renamed into it as the folder ``batch=<order>-<name>``. So a batch that breaks off leaves nothing that a
reader sees, one that is tried again replaces what it staged, and one that is in the table isn't inserted twice. With ``force``
a batch replaces what is stored under its keys: of several batches that hold a key the latest counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import names_in, numbered, rename
from .readers import path_exists

BATCH = "batch="


def read_snapshots(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The table's rows, one for each key, with the ``batch`` that it is from; empty if there is no table."""
    if not numbered(spark, path, BATCH):
        return spark.createDataFrame([], f"{schema}, batch string")
    rows = spark.read.schema(f"{schema}, batch string").parquet(path)
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_r")).select(key, "_r.*")


def stored_keys(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The keys that the table has; only that column is read."""
    return spark.read.schema(f"{schema}, batch string").parquet(path).select(key).distinct() if numbered(spark, path, BATCH) else spark.createDataFrame([], schema).select(key)


def stage(rows: DataFrame, path: str, key: str, name: str, order: Column, force: bool = False) -> str:
    """Write what a batch would insert beside the table; of its rows with one key the last by ``order`` counts, and a null key is left out."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    rest = [F.col(c) for c in rows.columns if c != key]
    new = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")
    if not force:
        new = new.join(stored_keys(rows.sparkSession, path, schema, key), key, "left_anti")
    staged = f"{path}/_staged/{name}"
    new.select(rows.columns).write.mode("overwrite").parquet(staged)
    return staged


def insert_absent(rows: DataFrame, path: str, key: str, name: str, order: Column | None = None, force: bool = False) -> bool:
    """Insert a batch into the table at ``path``; False if the batch of this name is there already.

    One writer at a time inserts; a stream's ``foreachBatch`` is one.
    """
    spark = rows.sparkSession
    if any(n.startswith(BATCH) and n.partition("-")[2] == name for n in names_in(spark, path)):
        return False
    staged = stage(rows, path, key, name, F.xxhash64(*rows.columns) if order is None else order, force)
    last = max(numbered(spark, path, BATCH), default=0)
    rename(spark, staged, f"{path}/{BATCH}{last + 1:010d}-{name}")
    return True


def exists(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, path) and bool(numbered(spark, path, BATCH))
