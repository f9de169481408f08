"""Reports over records: counts of a directory, of the three stages, and of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def counts(records: DataFrame, stage: str | None = None) -> DataFrame:
    """(stage, kind, value, n): statuses, types, flags and failed extractors of flat rows (status, document_type, review_flags, failed_extractors)."""
    empty = F.array().cast("array<string>")
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    each = lambda kind: lambda x: pair(kind, x)
    arrays = [F.transform(F.coalesce(F.col(c), empty), each(k)) for k, c in (("review_flag", "review_flags"), ("failed_extractor", "failed_extractors"))]
    rows = F.concat(
        F.array(pair("status", F.coalesce("status", F.lit(UNKNOWN))), pair("document_type", F.coalesce(F.when(F.col("document_type") != "", F.col("document_type")), F.lit(UNKNOWN))), pair("file_count", F.lit(""))),
        *arrays,
    )
    name = F.col("stage") if stage is None else F.lit(stage)
    return records.select(name.alias("stage"), F.explode(rows).alias("r")).groupBy("stage", "r.kind", "r.value").agg(F.count(F.lit(1)).alias("n"))


def listed_files(records: DataFrame) -> DataFrame:
    """(list, file_name) of the records that need review or failed; a table, as it grows with the records."""
    which = F.array(F.when(F.col("needs_manual_review"), "needing_review"), F.when(F.col("status") == "failed", "failed"))
    return records.select(F.explode(F.array_compact(which)).alias("list"), "file_name")


def stage_report(parsed: DataFrame, validated: DataFrame, review: DataFrame) -> DataFrame:
    """``counts`` of the three stages in one pass."""
    staged = [df.withColumn("stage", F.lit(name)) for name, df in (("parsed", parsed), ("validated", validated), ("review_queue", review))]
    return counts(staged[0].unionByName(staged[1]).unionByName(staged[2]))


def as_json(report: DataFrame) -> DataFrame:
    """A report as one JSON object a row."""
    return report.select(F.to_json(F.struct("*")).alias("value"))


def unfinished(records: DataFrame) -> DataFrame:
    """Partial and failed records with their flags as text."""
    return records.where(F.col("status").isin("partial", "failed")).select("file_name", "status", F.array_join(F.coalesce("review_flags", F.array().cast("array<string>")), ", ").alias("flags"))


def run_counters(results: DataFrame) -> DataFrame:
    """One row: how many files a run processed, sent to review, failed and skipped."""
    return results.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("processed", "review", "failed", "skipped")])
