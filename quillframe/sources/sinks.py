"""Sinks: tables keyed by document, routed so that each is in exactly one place; appends that never repeat a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .readers import path_exists


def write_routed(records: DataFrame, path: str, route: str = "route") -> None:
    """One table partitioned by route; a whole rewrite, so no record is left in its old place."""
    records.write.mode("overwrite").partitionBy(route).parquet(path)


def write_records(records: DataFrame, path: str) -> None:
    """A table of records; of several with one file stem the last path wins."""
    latest(records, ["case_id"], "path").select(records.columns).write.mode("overwrite").parquet(path)


def append_new(rows: DataFrame, path: str, keys: Sequence[str], force: bool = False) -> DataFrame:
    """Append the rows whose key the table lacks (all, with ``force``) and return what the table now holds, the latest row of each key last."""
    spark = rows.sparkSession
    if path_exists(spark, path) and not force:
        known = spark.read.parquet(path).select(*keys).distinct()
        rows = rows.join(known, list(keys), "left_anti")
    rows.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key: the state that an append-only log describes."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def archive_names(files: DataFrame, taken: DataFrame, target: str = "target", name: str = "file_name", order: str = "path") -> DataFrame:
    """Files with ``archived_name``: the name itself if it is free in its target, else with the first suffixes ``__2``, ``__3``, ... after those taken.

    ``taken`` has (target, file_name, n), how many of a name a target holds.
    """
    w = Window.partitionBy(target, name).orderBy(order)
    held = taken.select(F.col(target).alias("_t"), F.col(name).alias("_f"), F.col("n").alias("_n"))
    numbered = files.withColumn("_k", F.row_number().over(w)).join(held, (F.col(target) == F.col("_t")) & (F.col(name) == F.col("_f")), "left")
    k = F.col("_k") + F.coalesce("_n", F.lit(0))
    stem, suffix = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return numbered.withColumn("archived_name", F.when(k == 1, F.col(name)).otherwise(F.concat(stem, F.lit("__"), k.cast("string"), suffix))).drop("_k", "_t", "_f", "_n")


def write_json_lines(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def backup(table: DataFrame, path: str) -> None:
    """A copy of one snapshot of a table; fails if the copy exists."""
    table.write.mode("error").parquet(path)
