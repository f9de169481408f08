"""Sync of numbered cases: each run looks at the next responses of every key, remembers where it stopped, and hands its hits on.

A run is one streaming query over the responses. Each of its batches is scanned with window functions, from where the scan of a key stands: that is read from
the state table of the run before and from what the earlier batches of this run have logged. What a run looks at is logged by batch, and so are the hits that are
stored and ingested; all of it is named by run and batch, so a run that broke off goes on with the same names and repeats nothing. The state table gets its new
rows last, which ends the run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.folders import numbered, rename
from .inbox import MAX_CANDIDATES, MAX_MISSES, checkpoint

RUN = "run="


def scan(responses: DataFrame, state: DataFrame, key: str, max_candidates: int, max_misses: int) -> DataFrame:
    """Looks at a key's responses in order of their sequence, from the next one on, until ``max_misses`` come in a row, one says stop, or ``max_candidates`` are through.

    ``state`` has (key, _next, _misses, _seen, _ended): where the scans stand; a key that isn't there begins at 0. Of a key only as many rows are sorted whole as a scan
    may look at. Returns (key, sequence, outcome, misses, body), ``misses`` as they come in a row, ``body`` of hits.
    """
    order = ["sequence", "outcome", "body"]
    sorted_rows = Window.partitionBy(key).orderBy(*order)
    so_far = sorted_rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = responses.join(state, key, "left").where(~F.coalesce("_ended", F.lit(False)) & (F.col("sequence") >= F.coalesce("_next", F.lit(0))))
    rows = rows.withColumn("_n", F.row_number().over(sorted_rows)).where(F.col("_n") <= max_candidates)
    rows = rows.withColumn("_hits", F.count_if(F.coalesce(F.col("outcome") == "hit", F.lit(False))).over(so_far))
    run = Window.partitionBy(key, "_hits").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    handed_on = F.when(F.col("_hits") == 0, F.coalesce("_misses", F.lit(0))).otherwise(0)
    rows = rows.withColumn("misses", (F.count_if(F.coalesce(F.col("outcome") == "miss", F.lit(False))).over(run) + handed_on).cast("long"))
    ends = F.coalesce((F.col("misses") >= max_misses) | (F.col("outcome") == "stop"), F.lit(False))
    rows = rows.withColumn("_ends", F.count_if(ends).over(sorted_rows.rowsBetween(Window.unboundedPreceding, -1)))
    looked = rows.where((F.col("_ends") == 0) & (F.col("_n") + F.coalesce("_seen", F.lit(0)) <= max_candidates))
    return looked.select(key, "sequence", "outcome", "misses", F.when(F.col("outcome") == "hit", F.col("body")).alias("body"))


def _looked_schema(key: str, kind: str) -> str:
    return f"`{key}` {kind}, sequence long, outcome string, misses long, body string"


def read_state(spark: SparkSession, out: str, key: str, kind: str, run: int | None = None) -> DataFrame:
    """(key, last_checked, next, consecutive_misses) after a run, by default the last one that ended; empty before the first."""
    runs = numbered(spark, f"{out}/state", RUN)
    schema = f"`{key}` {kind}, last_checked long, next long, consecutive_misses long"
    return spark.read.schema(schema).parquet(f"{out}/state/{RUN}{run if run is not None else runs[-1]}") if runs else spark.createDataFrame([], schema)


def read_looked(spark: SparkSession, out: str, key: str, kind: str) -> DataFrame:
    """The log of what all runs have looked at, with ``run`` and ``batch``."""
    return spark.read.schema(f"{_looked_schema(key, kind)}, run long, batch long").option("basePath", f"{out}/looked").parquet(f"{out}/looked/{RUN}*")


def _standing(spark: SparkSession, out: str, key: str, kind: str, run: int, number: int, max_candidates: int, max_misses: int) -> DataFrame:
    """The ``state`` of ``scan`` before a run's batch of this number."""
    before = read_state(spark, out, key, kind).select(key, F.col("next").alias("_next"), F.lit(0).cast("long").alias("_misses"), F.lit(0).cast("long").alias("_seen"), F.lit(False).alias("_ended"))
    if not number:
        return before
    looked = read_looked(spark, out, key, kind).where((F.col("run") == run) & (F.col("batch") < number))
    seen, misses = F.count(F.lit(1)), F.max_by("misses", F.struct("sequence", "outcome", "misses"))
    ended = (seen >= max_candidates) | (F.max("misses") >= max_misses) | F.bool_or(F.coalesce(F.col("outcome") == "stop", F.lit(False)))
    after = looked.groupBy(key).agg((F.max("sequence") + 1).alias("_next"), misses.alias("_misses"), seen.alias("_seen"), ended.alias("_ended"))
    return after.union(before.join(after.select(key), key, "left_anti"))


def sync(responses: DataFrame, out: str, key: str, on_hits: Callable[[DataFrame, str], None], max_candidates: int = MAX_CANDIDATES, max_misses: int = MAX_MISSES, start: int = 0) -> int:
    """One run over a stream of responses (key, sequence, outcome, body), to its end; returns the run's number.

    ``outcome`` is hit, miss or stop. The hits of a batch (key, sequence, body) go to ``on_hits`` with the batch's name, which may get a batch again after
    a failure. Sequences below ``start`` count as looked at. Responses of a key should come in the order of their sequence, file by file.
    """
    spark = responses.sparkSession
    kind = responses.schema[key].dataType.simpleString()
    run = max(numbered(spark, f"{out}/state", RUN), default=0) + 1
    before = read_state(spark, out, key, kind)
    rows = responses.select(key, F.col("sequence").cast("long").alias("sequence"), "outcome", F.col("body").cast("string").alias("body")).where(F.col(key).isNotNull() & (F.col("sequence") >= start))

    def batch(found: DataFrame, number: int) -> None:
        place = f"{out}/looked/{RUN}{run}/batch={number}"
        standing = _standing(found.sparkSession, out, key, kind, run, number, max_candidates, max_misses)
        scan(found, standing, key, max_candidates, max_misses).write.mode("overwrite").parquet(place)  # read from here on: the batch is scanned once
        kept = found.sparkSession.read.schema(_looked_schema(key, kind)).parquet(place)
        on_hits(kept.where("outcome = 'hit'").select(key, "sequence", "body"), f"{run}-{number}")

    query = rows.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/streams/{RUN}{run}").trigger(availableNow=True).start()
    query.awaitTermination()
    after = checkpoint(read_looked(spark, out, key, kind).where(F.col("run") == run), [key], "sequence") if numbered(spark, f"{out}/looked", RUN) and run in numbered(spark, f"{out}/looked", RUN) else before.limit(0)
    state = after.select(before.columns).union(before.join(after.select(key), key, "left_anti"))
    state.write.mode("overwrite").parquet(f"{out}/_state/{RUN}{run}")
    rename(spark, f"{out}/_state/{RUN}{run}", f"{out}/state/{RUN}{run}")
    return run
