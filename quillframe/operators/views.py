"""A view that is kept up to date by recomputing what has changed.

A view holds what a function makes of the rows of a source, by key. Beside it lies a table of the signatures (of a file: path, time and size) that the rows had. A
refresh compares signatures, computes only new and changed keys, and rewrites only the buckets they fall in. Buckets are folders of a version; the list
of the versions that are valid is one small file, created last and only if no other refresh came first. So readers see the view of
before or that of after, and a refresh that breaks off leaves nothing they see.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import names_in, put_new, text_of
from ..sources.readers import remove_path

BUCKETS = 64


@dataclass(frozen=True)
class Refreshed:
    """What a refresh did: its version, how many keys were computed and how many went, and how many buckets were rewritten."""

    version: int
    computed: int
    gone: int
    buckets: int


def _valid(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(version, what is valid) of the view; version 0 before the first refresh. What is valid: the number of buckets, and for ``rows`` and ``signatures`` the folder of each filled bucket."""
    known = [int(n) for n in names_in(spark, f"{path}/valid") if n.isdigit()]
    if not known:
        return 0, {"buckets": 0, "rows": {}, "signatures": {}}
    return max(known), json.loads(text_of(spark, f"{path}/valid/{max(known):010d}"))


def _read(spark: SparkSession, path: str, name: str, schema: str, valid: dict, buckets: set[int] | None = None) -> DataFrame:
    """The valid rows of ``rows`` or ``signatures``, of all or some buckets; no other folder is opened."""
    folders = [f"{path}/{name}/{of}/bucket={b}" for b, of in sorted(valid[name].items()) if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_view(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The view as its last refresh left it; empty before the first."""
    return _read(spark, path, "rows", schema, _valid(spark, path)[1])


def changes(source: DataFrame, known: DataFrame, key: str, signature: Column) -> DataFrame:
    """(key, change) of the keys that are ``new``, ``changed`` or ``gone`` against a table (key, signature)."""
    now, then = source.select(key, signature.alias("_now")), known.select(F.col(key).alias("_key"), F.col("signature").alias("_then"))
    both = now.join(then, F.col(key) == F.col("_key"), "full_outer")
    change = F.when(F.col("_key").isNull(), "new").when(F.col(key).isNull(), "gone").when(F.col("_now") != F.col("_then"), "changed")
    return both.select(F.coalesce(key, "_key").alias(key), change.alias("change")).where("change is not null")


def refresh(source: DataFrame, key: str, signature: Column, path: str, compute: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> Refreshed:
    """Bring the view at ``path`` up to date with ``source``, whose ``key`` is unique; without a view, all keys are new.

    ``compute`` makes rows (with the key) of source rows, each key's by itself; it gets the new and changed ones only. The number of buckets is that of the first refresh.
    A refresh that another one has overtaken is an error, and changes nothing.
    """
    spark = source.sparkSession
    version, valid = _valid(spark, path)
    buckets, own = valid["buckets"] or buckets, f"version={version + 1}-{uuid.uuid4().hex}"
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    kind = source.schema[key].dataType.simpleString()
    signed = f"`{key}` {kind}, signature string"
    known = _read(spark, path, "signatures", signed, valid)
    changes(source, known, key, signature.cast("string")).withColumn("bucket", bucket).write.parquet(f"{path}/changes/{own}")
    changed = spark.read.schema(f"`{key}` {kind}, change string, bucket int").parquet(f"{path}/changes/{own}")
    tally = changed.groupBy("bucket").agg(F.count_if(F.col("change") != "gone").alias("computed"), F.count_if(F.col("change") == "gone").alias("gone")).collect()  # one row a bucket
    touched = {r["bucket"] for r in tally}
    if touched:
        fresh = source.join(changed.where("change <> 'gone'").select(key), key, "left_semi")
        made = compute(fresh)
        new = {"rows": made, "signatures": fresh.select(key, signature.cast("string").alias("signature"))}
        for name, rows in new.items():
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
            stays = _read(spark, path, name, schema, valid, touched).join(changed.select(key), key, "left_anti")
            rows.unionByName(stays).withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{name}/{own}")
            filled = {n.partition("=")[2]: own for n in names_in(spark, f"{path}/{name}/{own}") if n.startswith("bucket=")}
            valid[name] = {b: of for b, of in valid[name].items() if int(b) not in touched} | filled
        if not put_new(spark, f"{path}/valid/{version + 1:010d}", json.dumps(valid | {"buckets": buckets})):
            raise FileExistsError(f"{path}: another refresh made version {version + 1}")
    remove_path(spark, f"{path}/changes/{own}")
    return Refreshed(version + bool(touched), sum(r["computed"] for r in tally), sum(r["gone"] for r in tally), len(touched))


def sweep(spark: SparkSession, path: str) -> int:
    """Delete the folders that the view's last version doesn't need, once no reader of an older version is left; returns how many."""
    _, valid = _valid(spark, path)
    old = [f"{path}/{name}/{of}" for name in ("rows", "signatures") for of in names_in(spark, f"{path}/{name}") if of not in set(valid[name].values())]
    for folder in old:
        remove_path(spark, folder)
    return len(old)


def file_signature() -> Column:
    """The signature of a file from the columns of its metadata: path, time and size."""
    meta = F.col("_metadata")
    return F.concat_ws("|", meta["file_path"], F.unix_micros(meta["file_modification_time"]).cast("string"), meta["file_size"].cast("string"))
