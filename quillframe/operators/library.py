"""The owner's library as an append-only revision log: staging, publishing, conflicts, orphans.

A table of (id, revision, ...) rows is only ever appended to; the state is the latest row of each id. Several drivers may write: each
appends its rows first, which nobody sees, and then takes the next number of the list of commits, which only one can.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.folders import names_in, put_new
from ..sources.readers import path_exists, remove_path
from ..sources.sinks import latest


class ConflictError(ValueError):
    """A change that is based on an old revision, or that would give two cases one identity."""


def current(log: DataFrame) -> DataFrame:
    """The latest revision of each case; deleted ones are left out."""
    return latest(log, ["id"], "revision").where("not deleted")


def conflicts(changes: DataFrame, state: DataFrame) -> DataFrame:
    """(id, reason) of changes (id, revision they are based on, case_number, document_type) that must not be saved.

    A change is stale if it is based on another revision than the state has, and a duplicate if another case, in the state or among the
    changes, has its identity, or if its case is changed twice.
    """
    s = state.select(F.col("id").alias("_id"), F.col("revision").alias("_revision"))
    stale = changes.join(s, F.col("id") == F.col("_id"), "left").where(F.coalesce("_revision", F.lit(0)) != F.col("revision")).select("id", F.lit("stale").alias("reason"))
    t = state.select(F.col("id").alias("_id"), F.col("case_number").alias("_number"), F.col("document_type").alias("_type"))
    taken = changes.join(t, (F.col("case_number") == F.col("_number")) & (F.col("document_type") == F.col("_type")) & (F.col("id") != F.col("_id"))).select("id", F.lit("duplicate").alias("reason")).distinct()
    named = changes.where("case_number is not null and document_type is not null").groupBy("case_number", "document_type")
    twins = named.agg(F.collect_set("id").alias("_ids"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.explode("_ids").alias("id"))
    twice = changes.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("id")
    within = twins.union(twice).select("id", F.lit("duplicate").alias("reason"))
    return stale.union(taken.union(within).distinct())


def save(log: DataFrame, changes: DataFrame, path: str) -> None:
    """Append changes as the next revision; all or none."""
    wrong = conflicts(changes, current(log)).first()
    if wrong:
        raise ConflictError(f"{wrong['id']}: {wrong['reason']}")
    changes.withColumn("revision", F.col("revision") + 1).select(log.columns).write.mode("append").parquet(path)


def resolve_targets(drafts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Drafts with the case they belong to: the one asked for, else one with the same file, else one with the same identity now or before; else none.

    ``catalog`` has (case_id, document_hash, case_number, document_type, raw_number, raw_type). ``candidates`` above 1 is an error of the caller's to tell.
    """
    by_file = catalog.where("document_hash is not null").groupBy("document_hash").agg(F.min("case_id").alias("_by_file"))
    names = catalog.select("case_id", F.explode(F.array(F.struct(F.col("case_number").alias("n"), F.col("document_type").alias("t")), F.struct(F.col("raw_number").alias("n"), F.col("raw_type").alias("t")))).alias("i")).select("case_id", "i.*").where("n is not null").distinct()
    by_name = names.groupBy("n", "t").agg(F.min("case_id").alias("_by_name"), F.count_distinct("case_id").alias("_many"))
    known = catalog.select(F.col("case_id").alias("_asked")).distinct()
    out = drafts.join(by_file, "document_hash", "left").join(by_name, (F.col("case_number") == F.col("n")) & (F.col("document_type") == F.col("t")), "left").join(known, F.col("target_id") == F.col("_asked"), "left")
    target = F.coalesce("_asked", "_by_file", "_by_name")
    many = F.when(F.coalesce("_asked", "_by_file").isNotNull(), 1).otherwise(F.coalesce("_many", F.lit(0)))
    return out.withColumns({"target": target, "candidates": many}).drop("_asked", "_by_file", "_by_name", "_many", "n", "t")


def orphan_files(files: DataFrame, drafts: DataFrame, cases: DataFrame, key: str = "hash") -> DataFrame:
    """Files that no draft and no case refers to."""
    used = lambda df: df.select(F.col("document_hash").alias(key)).where(f"{key} is not null").distinct()
    return files.join(used(drafts), key, "left_anti").join(used(cases), key, "left_anti")


def drafts_with_files(drafts: DataFrame, files: DataFrame) -> DataFrame:
    """Drafts with their file's name, newest first."""
    return drafts.join(files.select(F.col("hash").alias("document_hash"), "filename"), "document_hash").orderBy(F.desc("created_at"), "id")


def case_file(cases: DataFrame, files: DataFrame, case_id: str) -> DataFrame:
    """The stored file of one case or draft."""
    return files.join(cases.where(F.col("id") == case_id).select(F.col("document_hash").alias("hash")), "hash", "left_semi")


def form_values(record: str = "") -> dict[str, Column]:
    """Columns of an owner's form from a record: lists as text."""
    p = f"{record}." if record else ""
    return {
        **{c: F.coalesce(F.col(f"{p}document.{c}"), F.lit("")) for c in ("case_number", "document_type", "decision_date")},
        "applicants": F.array_join(F.transform(F.col(f"{p}parties.applicants"), lambda x: x["name"]), "\n"),
        "judges": F.array_join(f"{p}adjudicators.judges", "\n"),
        "clerks": F.array_join(f"{p}adjudicators.clerks", "\n"),
        "dictum": F.array_join(f"{p}outcome.dictum", "\n\n"),
    }


def new_entries(manifest: DataFrame, catalog: DataFrame) -> DataFrame:
    """Manifest entries whose identity (number, type) the catalog lacks."""
    return manifest.join(catalog.select("case_number", "document_type").distinct(), ["case_number", "document_type"], "left_anti")


def staged(uploads: DataFrame, catalog: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(drafts, errors) of uploads (draft_id, target_id, document_hash, case_number, document_type, record, created_at).

    A draft knows its target, the revision it is based on, and the edits that the target has already. A target asked for must exist, and an
    identity of several cases needs one. New targets are named by file and draft.
    """
    found = resolve_targets(uploads, catalog)
    error = F.when(F.col("target_id").isNotNull() & ~F.col("target").eqNullSafe(F.col("target_id")), "unknown target").when(F.col("candidates") > 1, "several cases")
    new = F.concat(F.lit("case-"), F.substring(F.sha2(F.concat_ws("/", "document_hash", "draft_id"), 256), 1, 32))
    base = cases.select(F.col("id").alias("_id"), F.col("revision").alias("_revision"), F.col("edits").alias("_edits"))
    found = found.withColumns({"error": error, "target": F.coalesce("target", new)}).join(base, F.col("target") == F.col("_id"), "left")
    drafts = found.where("error is null").select(F.col("draft_id").alias("id"), "target", "record", F.col("_edits").alias("edits"), "document_hash", F.coalesce("_revision", F.lit(0)).cast("long").alias("base"), "created_at")
    return drafts, found.where("error is not null").select("draft_id", "error")


def published(drafts: DataFrame, fields: DataFrame) -> DataFrame:
    """The changes that publishing makes of drafts and the owner's fields (draft_id, case_number, document_type, edits): a null ``edits`` keeps the draft's."""
    given = fields.select("draft_id", F.replace("case_number", F.lit(" "), F.lit("")).alias("case_number"), "document_type", F.col("edits").alias("_edits"))
    rows = drafts.join(given, drafts["id"] == given["draft_id"])
    return rows.select(F.col("target").alias("id"), F.col("base").alias("revision"), "case_number", "document_type", "record", F.coalesce("_edits", "edits").alias("edits"), "document_hash", "draft_id")


class Library:
    """The owner's library in a folder: logs of cases, drafts and files, which only grow, and the contents of the files beside them.

    A change is one commit: its rows are written as the folders ``batch=<id>`` of the logs, and count once the file ``commits/<version>`` names the batch.
    That file is created for the version after the one that the change was checked against, and only where there is none. Of two drivers that
    change the same state one gets the version; the other looks at the new state and checks again. Rows of a commit that broke off are never seen.
    """

    CASES = "id string, revision long, case_number string, document_type string, record string, edits string, document_hash string, draft_id string, deleted boolean"
    DRAFTS = "id string, revision long, target string, record string, edits string, document_hash string, base long, created_at timestamp, deleted boolean"
    FILES = "hash string, revision long, filename string, deleted boolean"
    CONTENTS = "hash string, content binary"
    #: How often a change is tried against a newer state before it gives up.
    TRIES = 20

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        return max((int(n) for n in names_in(self.spark, f"{self.folder}/commits") if n.isdigit()), default=0)

    def _log(self, name: str, schema: str, version: int | None = None) -> DataFrame:
        """The committed rows of a log, up to a version."""
        path = f"{self.folder}/{name}"
        if not path_exists(self.spark, path) or not path_exists(self.spark, f"{self.folder}/commits"):
            return self.spark.createDataFrame([], schema)
        commits = self.spark.read.text(f"{self.folder}/commits", wholetext=True).select(F.col("value").alias("batch"), F.col("_metadata.file_name").cast("long").alias("_version"))
        if version is not None:
            commits = commits.where(F.col("_version") <= version)
        rows = self.spark.read.schema(f"{schema}, batch string").parquet(path)
        return rows.join(commits.select("batch"), "batch", "left_semi").drop("batch")

    def _commit(self, change: Callable[[int], dict[str, tuple[DataFrame, str]]]) -> None:
        """Write what ``change`` makes of the state at a version, as the next version. ``change`` raises a ConflictError if it can't be made."""
        for _ in range(self.TRIES):
            version, batch = self.version(), uuid.uuid4().hex
            for name, (rows, schema) in change(version).items():
                columns = self.spark.createDataFrame([], schema).columns
                rows.select(*columns).write.parquet(f"{self.folder}/{name}/batch={batch}")
            if put_new(self.spark, f"{self.folder}/commits/{version + 1:010d}", batch):
                return
        raise ConflictError(f"{self.TRIES} other changes came first")

    def cases(self, version: int | None = None) -> DataFrame:
        return current(self._log("cases", self.CASES, version))

    def drafts(self, version: int | None = None) -> DataFrame:
        done = self._log("cases", self.CASES, version).where("draft_id is not null").select(F.col("draft_id").alias("id")).distinct()
        return current(self._log("drafts", self.DRAFTS, version)).join(done, "id", "left_anti")

    def files(self, version: int | None = None) -> DataFrame:
        """(hash, revision, filename, deleted) of the files that are there; contents aren't read."""
        return latest(self._log("files", self.FILES, version), ["hash"], "revision").where("not deleted")

    def contents(self) -> DataFrame:
        """(hash, content) of the files that are there."""
        return self._log("contents", self.CONTENTS).dropDuplicates(["hash"]).join(self.files().select("hash"), "hash", "left_semi")

    def stage(self, uploads: DataFrame, catalog: DataFrame) -> DataFrame:
        """Store new files and a draft for each upload (with ``filename`` and ``content``); returns the errors, with which nothing is stored."""
        wrong: list[DataFrame] = []

        def change(version: int) -> dict[str, tuple[DataFrame, str]]:
            drafts, errors = staged(uploads, catalog, self.cases(version))
            wrong[:] = [errors]
            if not errors.isEmpty():
                raise ConflictError("uploads with errors")
            every = uploads.groupBy(F.col("document_hash").alias("hash")).agg(F.min_by("filename", "draft_id").alias("filename"), F.min("draft_id").alias("draft_id"))
            known = latest(self._log("files", self.FILES, version), ["hash"], "revision").select("hash", F.col("revision").alias("_r"), F.col("deleted").alias("_d"))
            new = every.join(known, "hash", "left").where("_r is null or _d").withColumns({"revision": F.coalesce("_r", F.lit(0)) + 1, "deleted": F.lit(False)})
            contents = uploads.join(new.select(F.col("hash").alias("document_hash"), "draft_id"), ["document_hash", "draft_id"], "left_semi").select(F.col("document_hash").alias("hash"), "content")
            first = drafts.withColumns({"revision": F.lit(1).cast("long"), "deleted": F.lit(False)})
            return {"contents": (contents, self.CONTENTS), "files": (new, self.FILES), "drafts": (first, self.DRAFTS)}

        try:
            self._commit(change)
        except ConflictError:
            if not wrong or wrong[0].isEmpty():
                raise
        return wrong[0]

    def publish(self, fields: DataFrame) -> None:
        """Drafts become cases, all or none, and are drafts no more."""

        def change(version: int) -> DataFrame:
            drafts = self.drafts(version)
            absent = fields.join(drafts.select(F.col("id").alias("draft_id")), "draft_id", "left_anti").first()
            if absent:
                raise ConflictError(f"{absent['draft_id']}: no such draft")
            return published(drafts, fields)

        self._save(change)

    def edit(self, changes: DataFrame) -> None:
        """Save (id, revision, case_number, document_type, edits) of cases, all or none; record and file stay."""
        self._save(lambda version: changes.join(self.cases(version).select("id", "record", "document_hash"), "id", "left").withColumn("draft_id", F.lit(None).cast("string")))

    def _save(self, make: Callable[[int], DataFrame]) -> None:
        def change(version: int) -> dict[str, tuple[DataFrame, str]]:
            changes = make(version)
            wrong = conflicts(changes, self.cases(version)).first()
            if wrong:
                raise ConflictError(f"{wrong['id']}: {wrong['reason']}")
            return {"cases": (changes.withColumns({"revision": F.col("revision") + 1, "deleted": F.lit(False)}), self.CASES)}

        self._commit(change)

    def discard(self, ids: DataFrame) -> None:
        """Drafts (draft_id) go, and with them the files that neither another draft nor a case refers to."""

        def change(version: int) -> dict[str, tuple[DataFrame, str]]:
            drafts = self.drafts(version)
            named = ids.select(F.col("draft_id").alias("id"))
            gone = drafts.join(named, "id", "left_semi").withColumns({"revision": F.col("revision") + 1, "deleted": F.lit(True)})
            orphans = orphan_files(self.files(version), drafts.join(named, "id", "left_anti"), self.cases(version))
            return {"drafts": (gone, self.DRAFTS), "files": (orphans.withColumns({"revision": F.col("revision") + 1, "deleted": F.lit(True)}), self.FILES)}

        self._commit(change)


def with_facts(records: DataFrame, facts: DataFrame, key: str = "file_name") -> DataFrame:
    """Records (columns of structs) with curated facts over them: structs of the same names in ``facts``, whose non-null fields replace the record's."""
    groups = [c for c in facts.columns if c != key]
    named = facts.select(key, *[F.col(g).alias(f"_{g}") for g in groups])
    rows = records.join(named, key, "left")
    for g in groups:
        over = facts.schema[g].dataType.names
        rows = rows.withColumn(g, functools.reduce(lambda c, f, g=g: c.withField(f, F.coalesce(F.col(f"_{g}")[f], F.col(g)[f])), over, F.col(g)))
    return rows.drop(*[f"_{g}" for g in groups])


def import_all(good: DataFrame, bad: DataFrame, path: str) -> DataFrame:
    """Write the accepted entries of a batch if none failed; else nothing, and a write that breaks off leaves no table. Returns the failures."""
    if bad.isEmpty():
        if path_exists(good.sparkSession, path):
            raise ConflictError(f"{path}: exists")
        try:
            good.write.mode("error").parquet(path)
        except Exception:
            remove_path(good.sparkSession, path)
            raise
    return bad


def import_counts(manifest: DataFrame, catalog: DataFrame, good: DataFrame | None = None, bad: DataFrame | None = None) -> DataFrame:
    """One row (added, skipped, pending, failed); without results, a dry run, new entries are pending."""
    new, every = new_entries(manifest, catalog).count(), manifest.count()
    dry = good is None or bad is None
    added, failed = (0, 0) if dry else (good.count(), bad.count())
    return manifest.sparkSession.range(1).select(*[F.lit(n).cast("long").alias(c) for c, n in (("added", added), ("skipped", every - new), ("pending", new if dry else 0), ("failed", failed))])


def import_batch(manifest: DataFrame, files: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, failures) of new entries: the file must be there with the checksum, and the text must name the case.

    ``files`` has (file_name, hash), ``parsed`` (file_name, case_number). Of several files or texts of one name all must fit, and the entry is accepted or fails
    once. The caller overlays facts (``with_facts``), checks and writes (``import_all``).
    """
    f = files.groupBy("file_name").agg(F.min("hash").alias("_hash"), F.max("hash").alias("_other"))
    number = F.coalesce("case_number", F.lit(""))
    t = parsed.groupBy("file_name").agg(F.min(number).alias("_number"), F.max(number).alias("_second"))
    rows = manifest.join(f, "file_name", "left").join(t, "file_name", "left")
    differs = lambda *found: functools.reduce(lambda a, b: a | b, found)
    named = F.coalesce("case_number", F.lit(""))
    reason = (
        F.when(F.col("_hash").isNull(), "missing file")
        .when(differs(F.col("_hash") != F.col("sha256"), F.col("_other") != F.col("sha256")), "checksum")
        .when(differs(~F.col("_number").eqNullSafe(named), ~F.col("_second").eqNullSafe(named)), "case number")
    )
    rows = rows.withColumn("reason", reason).drop("_hash", "_other", "_number", "_second")
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def numbered_drafts(drafts: DataFrame) -> DataFrame:
    """Drafts with their place among those of one target, oldest first."""
    return drafts.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy("created_at", "id")))
