"""Whole jobs over folders: parse, check, report, scaffold, ingest. One lazy plan each; failures are rows, not exceptions."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract, html, library, reports, validate
from ..sources import moves, readers, sinks, snapshots
from ..streaming import inbox, sync


def flat(records: DataFrame) -> DataFrame:
    """The columns that reports count."""
    return records.select(F.col("source.file_name").alias("file_name"), "parser.status", "document.document_type", "validation.review_flags", "parser.failed_extractors", "validation.needs_manual_review")


def parse(spark: SparkSession, path: str, out: str, schema: str | None = None) -> DataFrame:
    """Parse the texts of a folder into a table of records, checked against a JSON Schema (its text) if one is given; returns the unfinished ones."""
    texts = readers.read_texts(spark, path).withColumnRenamed("path", "pdf_path")
    records = extract.parse_documents(texts, schema=schema).withColumns({"case_id": F.regexp_replace("source.file_name", r"\.[^.]*$", ""), "path": F.col("source.pdf_path")})
    sinks.write_records(records, out)
    return reports.unfinished(flat(spark.read.parquet(out)))


def check(spark: SparkSession, records: DataFrame, out: str, schema: str | None = None) -> DataFrame:
    """Check records again and route each to exactly one partition; the parser's block stays, and without a schema its errors do."""
    if schema is not None:
        whole = F.struct(*[F.col(c) for c in records.columns if c not in ("case_id", "path")])
        records = records.withColumn("_errors", validate.record_errors(whole, schema))
        records = validate.with_validation(records, F.col("_errors")).drop("_errors")
    else:
        records = validate.with_validation(records)
    sinks.write_routed(validate.route(records), out)
    return spark.read.parquet(out)


def report(parsed: DataFrame, routed: DataFrame) -> DataFrame:
    """Counts of the three stages."""
    return reports.stage_report(flat(parsed), flat(routed.where("route = 'validated'")), flat(routed.where("route = 'review_queue'")))


def scaffold(routed: DataFrame, out: str) -> None:
    """Templates for checking by hand, of the records that need it."""
    sinks.write_json_lines(extract.manual_truth_template(routed.where("route = 'review_queue'")), out)


def run(spark: SparkSession, path: str, out: str, schema: str | None = None) -> DataFrame:
    """Parse, check, scaffold and report a folder under ``out``."""
    parse(spark, path, f"{out}/parsed", schema)
    parsed = spark.read.parquet(f"{out}/parsed")
    routed = check(spark, parsed, f"{out}/routed")
    scaffold(routed, f"{out}/manual_truth")
    return report(parsed, routed)


def _read_as_rulings(files: DataFrame, schema: str | None) -> DataFrame:
    """Records of (hash, path, text), checked, with ``hash``, ``path`` and the ``status`` that the manifest gets."""
    texts = files.select(F.col("path").alias("pdf_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "text")
    records = extract.parse_documents(texts, schema=schema).withColumn("path", F.col("source.pdf_path"))
    status = F.when(F.col("validation.needs_manual_review"), "review").otherwise("processed")
    return records.join(files.select("hash", "path"), "path").withColumn("status", status)


def ingest(spark: SparkSession, box: str, out: str, force: bool = False, schema: str | None = None, archive: bool = False) -> None:
    """Parse and check what is new in an inbox folder.

    With ``force``, all files that lie there are taken again, as a batch of their own name; readers take the latest batch of a content (``inbox.current``). With ``archive``,
    the files that were taken are moved to ``out``/archive/processed or /failed; copies of known contents stay where they are.
    """

    def done(name: str) -> None:
        if archive:
            taken = inbox.read_manifest(spark, f"{out}/manifest").where(F.col("batch") == name)
            files = taken.select("hash", F.col("source_path").alias("path"), F.when(F.col("status") == "failed", "failed").otherwise("processed").alias("target"))
            moves.archive(files, {t: f"{out}/archive/{t}" for t in ("processed", "failed")}, f"{out}/moves", name)

    process = functools.partial(_read_as_rulings, schema=schema)
    if force:
        inbox.ingest_forced(spark, box, f"{out}/manifest", f"{out}/records", process, after=done)
    else:
        inbox.ingest_inbox(spark, box, f"{out}/manifest", f"{out}/records", f"{out}/state", process, after=done).awaitTermination()


def archived(spark: SparkSession, out: str) -> DataFrame:
    """The manifest of an inbox, the latest entry of each content, with where its file was moved."""
    manifest = sinks.latest(inbox.read_manifest(spark, f"{out}/manifest"), ["hash"], "updated_at")
    moved = moves.read_moves(spark, f"{out}/moves").where("state = 'moved'").select("hash", "batch", "archived_path")
    return manifest.join(moved, ["hash", "batch"], "left").withColumn("source_name", F.element_at(F.split("source_path", "/"), -1))


def sync_and_ingest(responses: DataFrame, out: str, key: str, process: Callable[[DataFrame], DataFrame], max_candidates: int = inbox.MAX_CANDIDATES, max_misses: int = inbox.MAX_MISSES, force: bool = False) -> int:
    """One run of a sync over a stream of responses (key, sequence, outcome, body) whose hits are stored as snapshots and ingested; returns the run's number.

    A hit is stored under ``<key>/<sequence>``. ``process`` maps (hash, path, text) to records as in an inbox; contents that are known aren't ingested again.
    """

    def take(hits: DataFrame, name: str) -> None:
        rows = hits.select(F.concat_ws("/", F.col(key).cast("string"), F.col("sequence").cast("string")).alias("path"), F.coalesce("body", F.lit("")).alias("text"))
        snapshots.insert_absent(rows, f"{out}/snapshots", "path", name, force=force)
        inbox.record_batch(rows.withColumn("hash", F.sha2("text", 256)), name, f"{out}/manifest", f"{out}/records", process, force)

    return sync.sync(responses, f"{out}/scan", key, take, max_candidates, max_misses)


def ingest_html(spark: SparkSession, folder: str, out: str, labels: dict[str, str], stops: Sequence[str], base: str = "", force: bool = False) -> DataFrame:
    """Saved pages of cases: their HTML is stored where it is absent (or ``force``), what they say is stored anew as snapshots; returns (file_name, failure) of pages that name no case.

    ``base`` is the address that relative links belong to.
    """
    pages = readers.read_texts(spark, folder, "*.html").select(F.col("file_name").alias("page"), F.col("text").alias("html"), F.lit(base).alias("url"))
    cases = html.tracked_case(pages, "page", labels, stops).withColumn("slug", T.slugify_case_number(F.col("case_number")))
    found, name = cases.join(pages.select("page", "html"), "page").persist(), uuid.uuid4().hex
    snapshots.insert_absent(found.select("slug", "page", "html"), f"{out}/raw_html", "slug", name, F.col("page"), force)
    snapshots.insert_absent(found.drop("html"), f"{out}/snapshots", "slug", name, F.col("page"), force=True)
    found.unpersist()
    return pages.join(cases.select("page"), "page", "left_anti").select(F.col("page").alias("file_name"), F.lit("tracking HTML did not contain a recognizable case record").alias("failure"))


def import_collection(manifest: DataFrame, files: DataFrame, catalog: DataFrame, out: str, hosts: Sequence[str], facts: DataFrame | None = None, schema: str | None = None, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """Import a batch of a manifest into a new table ``out``, all of it or nothing; returns (counts, failures).

    ``manifest`` has (case_number, document_type, url, file_name, sha256), ``files`` (file_name, hash, text), ``catalog`` the identities that are there. An entry of the manifest that is
    faulty in itself stops the batch before any file is read. Files that are missing, differ from their checksum or name another case fail, and
    then nothing is written. ``facts`` (file_name and structs) overlay what the texts say. A dry run counts what would be imported.
    """
    faulty = validate.manifest_errors(manifest, hosts).where(F.size("errors") > 0).select("file_name", F.array_join("errors", ", ").alias("reason"))
    wrong = faulty.first()
    if wrong:
        raise library.ConflictError(f"{wrong['file_name']}: {wrong['reason']}")
    if dry_run:
        return library.import_counts(manifest, catalog), faulty
    new = library.new_entries(manifest, catalog)
    wanted = files.join(new.select("file_name").distinct(), "file_name", "left_semi")
    records = extract.parse_documents(wanted, schema=schema).withColumn("file_name", F.col("source.file_name"))
    good, bad = library.import_batch(new, wanted, records.select("file_name", "document.case_number"))
    good, bad = good.persist(), bad.persist()
    rows = records.join(good.select("file_name", "url"), "file_name").withColumn("source", F.col("source").withField("download_url", F.col("url"))).drop("url").dropDuplicates(["file_name"])
    if facts is not None:
        rows = validate.with_validation(library.with_facts(rows, facts))
    library.import_all(rows.withColumn("case_id", F.regexp_replace("file_name", r"\.[^.]*$", "")), bad, out)
    counts = library.import_counts(manifest, catalog, good if bad.isEmpty() else good.limit(0), bad)
    return counts, bad.select("file_name", "reason")
