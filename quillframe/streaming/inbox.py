"""Incremental ingest of an inbox folder, and the scan of numbered cases, both in batch and as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.folders import numbered
from ..sources.readers import path_exists

MAX_CANDIDATES, MAX_MISSES = 50, 20
MANIFEST = "hash string, source_path string, status string, updated_at timestamp, batch string"


def unseen(files: DataFrame, manifest: DataFrame, key: str = "hash", order: str = "path") -> DataFrame:
    """Files whose content isn't in the manifest, each content once (the first path)."""
    rest = [c for c in files.columns if c != key]
    return files.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_f")).select(key, "_f.*").join(manifest.select(key).distinct(), key, "left_anti")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest; empty where there is none. A file of it that can't be read counts as empty."""
    reader = spark.read.schema(MANIFEST).option("ignoreCorruptFiles", True)
    return reader.parquet(path) if path_exists(spark, path) else spark.createDataFrame([], MANIFEST)


def record_batch(files: DataFrame, name: str, manifest: str, records: str, process: Callable[[DataFrame], DataFrame], force: bool = False) -> None:
    """Process what is new in a batch of files (hash, path, text) and record it under the batch's name.

    Records and manifest are partitions ``batch=name``, which a repeated batch replaces: whatever an earlier try left, it is there once. What other
    batches have recorded isn't new, unless ``force`` is set.
    """
    spark = files.sparkSession
    known = read_manifest(spark, manifest).where(F.coalesce(F.col("batch"), F.lit("")) != name)
    done = process(unseen(files, known.limit(0) if force else known)).persist()
    done.write.mode("overwrite").parquet(f"{records}/batch={name}")
    log = done.select("hash", F.col("path").alias("source_path"), "status", F.current_timestamp().alias("updated_at"))
    log.write.mode("overwrite").parquet(f"{manifest}/batch={name}")
    done.unpersist()


def _as_files(texts: DataFrame) -> DataFrame:
    return texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.sha2("value", 256).alias("hash"))


def ingest_inbox(spark: SparkSession, inbox: str, manifest: str, records: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], pattern: str = "*.txt", after: Callable[[str], None] | None = None) -> StreamingQuery:
    """Take what is new in an inbox folder and stop: known contents are skipped, and every outcome is recorded, so failures aren't tried again.

    ``process`` maps (hash, path, text) to records with hash, ``status`` and whatever the record table holds. A batch that is repeated after a failure
    replaces what its first try left; batches are named by the stream's own id and their number, so another stream replaces nothing. ``after`` gets each
    batch's name once it is recorded, and gets it again if the batch is repeated.
    """

    def batch(files: DataFrame, number: int) -> None:
        name = f"{files.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number}"
        record_batch(files, name, manifest, records, process)
        if after:
            after(name)

    source = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).load(inbox)
    return _as_files(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_forced(spark: SparkSession, inbox: str, manifest: str, records: str, process: Callable[[DataFrame], DataFrame], pattern: str = "*.txt", after: Callable[[str], None] | None = None) -> str:
    """Take all that lies in an inbox folder again, known or not, as a batch ``forced-<n>``; returns the batch's name.

    The stream of ``ingest_inbox`` lists a file once, so the folder is read as a table here. A run that breaks off before its manifest is written leaves its number to the next.
    """
    name = f"forced-{max(numbered(spark, manifest, 'batch=forced-'), default=0) + 1}"
    texts = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", pattern).load(inbox)
    record_batch(_as_files(texts), name, manifest, records, process, force=True)
    if after:
        after(name)
    return name


def current(rows: DataFrame, manifest: DataFrame, key: str = "hash") -> DataFrame:
    """Of the rows of a record table (with ``batch``), those of each content's latest batch in the manifest."""
    last = manifest.groupBy(key).agg(F.max_by("batch", "updated_at").alias("batch"))
    return rows.join(last, [key, "batch"], "left_semi")


def dedupe_stream(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each key once, as long as its repeats come within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def miss_scan(candidates: DataFrame, keys: list[str], order: str, outcome: str, max_candidates: int = MAX_CANDIDATES, max_misses: int = MAX_MISSES) -> DataFrame:
    """The candidates that a scan in order looks at: it ends with the first of ``max_misses`` misses in a row, with a ``stop``, or after ``max_candidates``.

    ``outcome`` is hit, miss or stop. Adds ``misses``, how many came in a row up to a row.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    rows = candidates.withColumns({"_n": F.row_number().over(w), "_hits": F.sum(F.when(F.col(outcome) == "hit", 1).otherwise(0)).over(w)})
    run = Window.partitionBy(*keys, "_hits").orderBy(order)
    rows = rows.withColumn("misses", F.sum(F.when(F.col(outcome) == "miss", 1).otherwise(0)).over(run).cast("long"))
    ended = F.sum(F.when((F.col("misses") >= max_misses) | (F.col(outcome) == "stop"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_ended", F.coalesce(ended, F.lit(0)))
    return rows.where((F.col("_ended") == 0) & (F.col("_n") <= max_candidates)).drop("_n", "_hits", "_ended")


def checkpoint(scanned: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The state a scan leaves: the last candidate looked at, the next one, and the misses in a row."""
    return scanned.groupBy(*keys).agg(F.max(order).alias("last_checked"), (F.max(order) + 1).alias("next"), F.max_by("misses", order).alias("consecutive_misses"))


def scan_stream(results: DataFrame, key: str, max_misses: int = MAX_MISSES, max_candidates: int = MAX_CANDIDATES) -> DataFrame:
    """The same scan over a stream of (key, sequence, outcome): state is the misses in a row, how many were looked at, and whether the scan has ended."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        misses, seen, ended = state.get if state.exists else (0, 0, False)
        looked = []
        for row in pd.concat(list(batches)).sort_values("sequence").itertuples(index=False):
            if ended:
                break
            misses = misses + 1 if row.outcome == "miss" else 0 if row.outcome == "hit" else misses
            seen += 1
            ended = row.outcome == "stop" or misses >= max_misses or seen >= max_candidates
            looked.append((group[0], row.sequence, row.outcome, misses))
        state.update((misses, seen, ended))
        yield pd.DataFrame(looked, columns=[key, "sequence", "outcome", "misses"])

    kind = results.schema[key].dataType.simpleString()
    return results.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, sequence long, outcome string, misses long", "misses long, seen long, ended boolean", "append", "NoTimeout")
