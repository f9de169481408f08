"""The core queries: every operator in its parameterised form over the star-schema and text tables."""

from __future__ import annotations

import uuid

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import search_text as S
from ..functions import text as T
from ..operators import catalog, extract, html, library, numbering, reports, search, search_index, sections, stories, validate, views
from ..session import shared_folder
from ..sources import moves, sinks, snapshots
from ..streaming import inbox, sync
from . import jobs

# Parameters of the queries, shared with their SQL.
SHORT_LINE = 20
TERMS = ("the", "tion", "que")
NUMBER = r"(?U)\d{4,}"
SCAN_MISSES, SCAN_MOST = 2, 40
STORY_STEP = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows over all tasks: a small file is read by a task or two, which then do all the work on its rows."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def _short_line(line: Column) -> Column:
    return (F.length(line) <= SHORT_LINE) & (line != "")


def _sections(docs: DataFrame) -> DataFrame:
    return sections.explode_sections(docs.select("doc_id", "text"), "doc_id", is_heading=_short_line, titles=["-"])


# --- Text


def line_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections.number_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", _long("line_no").alias("line_no"), F.md5(F.col("line").cast("binary")).alias("line_md5"))


def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sections(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", _long("idx").alias("idx"), "heading", F.length("text").cast("long").alias("chars"), _long("start_line").alias("start_line"), _long("end_line").alias("end_line"))


def section_slug_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(table(spark, sf_dir, "documents")).groupBy("slug").agg(F.count(F.lit(1)).alias("n"))


def whitespace_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.normalize_whitespace(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.cast("binary")).alias("text_md5"), F.length(text).cast("long").alias("chars"))


def number_extract_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.extract_case_numbers(F.col("text"), NUMBER)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(found).alias("pos", "number")).select("doc_id", _long("pos").alias("pos"), "number")


def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = T.ordered_distinct(F.split(T.normalize_whitespace(F.col("text")), " "), F.lower)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(distinct, " ").cast("binary")).alias("words_md5"), F.size(distinct).cast("long").alias("n"))


def outcome_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verbs = {"purchase": "Mengabulkan permohonan untuk sebagian", "click": "Menolak permohonan", "view": "Permohonan tidak dapat diterima", "signup": "Menerima penarikan kembali"}
    summary = T.label_of(F.col("event_type"), verbs)
    return table(spark, sf_dir, "events").groupBy(T.classify_outcome(summary).alias("outcome_key")).agg(F.count(F.lit(1)).alias("n"))


def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.col("n_nationkey") + 2003
    return table(spark, sf_dir, "nation").select(_long("n_nationkey").alias("sequence"), T.to_roman(F.col("n_nationkey") * 161 + 1).alias("roman"), T.build_case_number(F.col("n_nationkey") + 1, F.lit("PUU"), year).alias("case_number"), T.slugify_case_number(T.build_case_number(F.col("n_nationkey") + 1, F.lit("PUU"), year)).alias("slug"))


def party_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("1. Pemohon: "), F.col("c_name"), F.lit(", selaku "), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.normalize_party_name(raw).alias("name"))


def date_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    shown = T.display_date(iso)
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("shown"), T.normalize_date(F.concat(F.lit("Diucapkan pada "), shown)).alias("parsed"))


# --- Search


def _searched(docs: DataFrame) -> list[search.Field]:
    lower = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    return [search.Field("source", F.col("source"), lower("source"), 50), search.Field("lang", F.col("lang"), lower("lang"), 35), search.Field("text", F.col("text"), lower("text"), 1)]


def search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("_t", F.lower("text"))
    return search.filter_rows(docs, S.Query(None, TERMS[:2]), {"lang": "en", "source": ""}, texts=("_t",)).select("doc_id", "lang", "source")


#: Searches of the index: the filter's own, short terms, a term across the fields, one that nothing holds, and a long one.
INDEX_TERMS = (TERMS[:2], ("e", "qu", "b"), ("s", "source", "the"), ("zqxjzq",), ("ation of the", "and"))


def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold all terms of each search in their lower-case text or source, from the postings alone."""
    path = f"{_fresh_folder(spark, 'index')}/postings"
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"), F.lower("source").alias("source"))
    search_index.write_index(docs, "doc_id", ["text", "source"], path)
    out = None
    for number, terms in enumerate(INDEX_TERMS):
        found = search_index.search_index(spark, path, "doc_id", terms).select(F.lit(number).cast("long").alias("search"), "doc_id")
        out = found if out is None else out.unionByName(found)
    return out


def search_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranked = search.rank(docs, _searched(docs), TERMS)
    return ranked.orderBy(F.desc("relevance"), F.desc("n_chars"), "doc_id").select("doc_id", _long("relevance").alias("relevance"), "n_chars")


def search_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.normalize_whitespace(F.col("text"))
    return table(spark, sf_dir, "documents").where(F.lower("text").contains(TERMS[1])).select("doc_id", search.excerpt(text, TERMS[1:2]).alias("excerpt"))


def best_match_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("source", F.concat("source", F.lit(" the")))
    return search.rank(docs, _searched(docs), TERMS[:1]).where("match_label is not null").select("doc_id", "match_label", F.md5(F.col("match_excerpt").cast("binary")).alias("excerpt_md5"))


def search_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = S.fold_texts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.split(folded, " ")).cast("long").alias("words"), F.md5(folded.cast("binary")).alias("folded_md5"))


def search_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = S.read_query("perkara nomor 0007/PUU-XXI/2023 kebebasan")
    numbers = T.build_case_number(F.col("o_orderkey") % 49 + 1, F.lit("PUU"), F.lit(2020) + F.col("o_orderkey") % 6)
    rows = table(spark, sf_dir, "orders").withColumn("case_number", numbers)
    return search.filter_rows(rows, S.Query(query.reference, ())).select("o_orderkey", "case_number")


def sort_newest_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, the newest first and the undated ones last."""
    return _dated_orders(spark, sf_dir).orderBy(*search.order_of("newest", F.col("o_orderkey"))).select("o_orderkey", "decision_date")


def catalog_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of every order in that order, from 0."""
    rows = _dated_orders(spark, sf_dir)
    return numbering.ordered(rows, search.order_of("newest", F.col("o_orderkey"))).select("position", "o_orderkey", "decision_date")


def _dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dated.alias("decision_date"), F.col("o_orderkey").cast("string").alias("case_number"), F.lit("x").alias("case_id"), F.lit("ok").alias("status"), F.lit(False).alias("needs_manual_review"), F.array().cast("array<string>").alias("review_flags"), F.lit("").alias("document_type"), F.lit(0).alias("relevance"))


def page_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return search.page(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facets(_flat(spark, sf_dir)).select("facet", "value", "n")


def facets_vs_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _flat(spark, sf_dir)
    whole, part = search.facets(flat).withColumnRenamed("n", "facet_n"), search.facets(flat.where("document_type = 'en'")).withColumnRenamed("n", "stat_n")
    return whole.join(part, ["facet", "value"], "left").select("facet", "value", "facet_n", F.coalesce("stat_n", F.lit(0)).alias("stat_n"))


def related_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that share two or more topics stand in for cases: a topic is a nation and segment, a second one a rounded balance."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.array(F.concat_ws("-", F.lit("n"), "c_nationkey", "c_mktsegment"), F.concat(F.lit("b"), F.floor(F.col("c_acctbal") / 10).cast("string"))).alias("topics"), F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("dated"))
    return search.related(rows, "c_custkey", "topics", "dated").select("c_custkey", _long("rank").alias("rank"), "other", "common")


# --- Checks and reports


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as flat catalog rows: flags by rules, status from labels, topics from the source."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    rows = docs.join(labels, "doc_id", "left")
    flags = validate.messages(_flag_rules())
    status = F.when(F.col("quality").isNull(), F.lit(None).cast("string")).when(F.col("quality") == 1, "ok").otherwise("partial")
    return rows.select(
        "doc_id", F.col("lang").alias("document_type"), status.alias("status"), flags.alias("review_flags"), (F.size(flags) > 0).alias("needs_manual_review"),
        F.array("source").alias("topics"), F.substring(F.col("n_chars").cast("string"), 1, 1).alias("year"), F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("file_name"),
        F.when(F.col("toxic") == 1, F.array(F.lit("parties"), F.lit("outcome"))).otherwise(F.array().cast("array<string>")).alias("failed_extractors"),
    )


def _flag_rules() -> list[tuple[str, Column]]:
    return [("too_short", F.col("n_chars") < 300), ("too_long", F.col("n_chars") > 10000), ("no_label", F.col("quality").isNull()), ("toxic", F.col("toxic").eqNullSafe(1))]


def _verdict_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as records whose parts are of all sizes: names of any length, some empty or suspicious, few or many sections, every kind of summary."""
    k = F.col("s_suppkey")
    person = lambda name: F.struct(name.alias("name"), F.lit("r").alias("role"))
    people = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: person(F.concat(F.lit("P "), i.cast("string"))))
    few = lambda n: F.when(n > 0, people(n)).otherwise(F.array().cast("array<struct<name:string,role:string>>"))
    odd = F.when(k % 6 == 0, "").when(k % 6 == 1, F.repeat(F.lit("n"), 121)).when(k % 6 == 2, F.concat("s_name", F.lit(" ALAMAT: x"))).otherwise(F.col("s_name"))
    summary = F.when(k % 8 == 0, F.lit(None)).when(k % 8 == 1, " ").when(k % 8 == 2, F.concat(F.lit("Menolak "), F.repeat(F.lit("x"), 160))).when(k % 8 < 6, F.concat(F.lit("MENGABULKAN "), "s_name")).otherwise(F.col("s_name"))
    parties = F.struct(
        F.when(k % 5 == 0, few(F.lit(0))).when(k % 5 == 1, people(F.lit(16))).otherwise(F.array(person(odd))).alias("applicants"), few(k % 11).alias("legal_counsels"), few(k % 6).alias("respondents"),
        few(k % 7).alias("experts"), few(k % 7).alias("witnesses"), few(k % 5).alias("amicus_curiae"),
    )
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", parties.alias("parties"), F.array_repeat(F.struct(F.lit("h").alias("heading")), (k % 5).cast("int")).alias("sections"),
        F.struct(F.when(k % 9 > 0, "2020-01-01").alias("decision_date"), F.when(k % 2 == 0, "putusan").otherwise("ketetapan").alias("document_type"), F.when(k % 13 > 0, F.col("s_name")).otherwise("").alias("case_number")).alias("document"),
        F.struct(F.array_repeat("s_name", (k % 3).cast("int")).alias("judges")).alias("adjudicators"), F.struct(summary.alias("summary"), F.array_repeat("s_name", (k % 3).cast("int")).alias("dictum")).alias("outcome"),
        F.struct(F.array_repeat(F.lit("Pasal 1"), (k % 4).cast("int")).alias("constitutional_articles")).alias("legal_basis"),
    )


def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate.with_validation(_verdict_records(spark, sf_dir))
    v = F.col("validation")
    return checked.select("s_suppkey", F.array_join(v["review_flags"], ",").alias("flags"), F.array_join(v["business_rule_errors"], ",").alias("errors"), v["needs_manual_review"].alias("needs_manual_review"))


def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flat(spark, sf_dir).select(F.explode("review_flags").alias("flag"), "doc_id").groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    return rows.orderBy(F.desc("n"), "first_doc")


#: A schema with all that the check knows, and the records that it is tried on, as JSON text.
SCHEMA = """{"type": "object", "required": ["status", "number", "title", "parties"], "properties": {"status": {"type": "string", "enum": ["ok", "partial"]}, "number": {"type": ["string", "null"]},
"title": {"type": ["string", "null"]}, "pages": {"type": "integer"}, "parties": {"type": "array", "items": {"$ref": "#/$defs/person"}}},
"$defs": {"person": {"type": "object", "required": ["name", "role"], "properties": {"name": {"type": "string"}, "role": {"type": "string"}}}}}"""


def schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON records with many faults: what the schema check tells of each."""
    key, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    raw = F.concat(
        F.when(key % 11 == 0, "[").otherwise(F.lit("")), F.lit('{"status": '), F.when(F.col("o_orderstatus") == "F", '"failed"').when(F.col("o_orderstatus") == "O", '"ok"').otherwise("null"),
        F.lit(', "number": '), F.when(key % 3 == 0, text).otherwise(F.concat(F.lit('"'), text, F.lit('"'))), F.when(F.col("o_orderpriority").startswith("1"), "").otherwise(', "title": null'),
        F.when(key % 7 == 0, ', "pages": 1.5').when(key % 7 == 1, ', "pages": true').otherwise(', "pages": 12'), F.lit(', "parties": '),
        F.when(key % 5 == 0, '{}').when(key % 5 == 1, '[{"name": "a", "role": "b"}, {"role": 7}, "x"]').otherwise('[{"name": null, "role": "b"}, {"name": "a"}]'), F.lit("}"),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(validate.schema_errors(raw, SCHEMA), "; ").alias("errors"))


def route_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = validate.route(_flat(spark, sf_dir).withColumn("validation", F.struct("needs_manual_review")))
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def directory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts(_flat(spark, sf_dir), "parsed").select("stage", "kind", "value", "n")


def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _flat(spark, sf_dir)
    return reports.stage_report(flat, flat.where("not needs_manual_review"), flat.where("needs_manual_review")).select("stage", "kind", "value", "n")


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.listed_files(_flat(spark, sf_dir))


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("status") == "ok", "processed").when(F.col("status") == "partial", "review").otherwise("skipped")
    return reports.run_counters(_flat(spark, sf_dir).select(status.alias("status")))


def display_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compact_turns(table(spark, sf_dir, "conversations"), F.col("text"))


def _compact_turns(rows: DataFrame, text: Column) -> DataFrame:
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", text.alias("t")))).alias("x"))
    shown = validate.compact(F.transform("x", lambda x: x["t"]), 2, 50)
    return turns.select("conv_id", shown["hidden"].cast("long").alias("hidden"), F.size(shown["shown"]).cast("long").alias("n_shown"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an edited order changes: priorities of some orders, prices of none."""
    given = F.struct(F.when(F.col("o_orderkey") % 3 == 0, "0-NEW").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"), F.col("o_orderstatus"))
    edits = validate.corrections(F.struct("o_orderpriority", "o_orderstatus"), given, ["o_orderpriority", "o_orderstatus"])
    return table(spark, sf_dir, "orders").select("o_orderkey", edits["o_orderpriority"].alias("priority"), edits["o_orderstatus"].alias("status"))


def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier rows as entries of a manifest, some with a wrong address, name, checksum or identity."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        (k - F.when(k % 10 == 0, 1).otherwise(0)).cast("string").alias("case_number"), F.lit("putusan").alias("document_type"),
        F.concat(F.lit("https://"), F.when(k % 7 == 0, "evil.example").otherwise("files.example"), F.lit("/"), k.cast("string"), F.lit(".pdf")).alias("url"),
        F.concat(F.when(k % 11 == 0, "a/").otherwise(""), k.cast("string"), F.lit(".pdf")).alias("file_name"), F.when(k % 13 == 0, F.lit("x")).otherwise(F.sha2(k.cast("string"), 256)).alias("sha256"), "s_suppkey",
    )
    return validate.manifest_errors(rows, ["files.example"]).select("s_suppkey", F.array_join("errors", ",").alias("errors"))


# --- Joins and state


def content_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of an inbox whose manifest holds the passages of the benchmark."""
    files = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("hash"), F.col("doc_id").alias("path"), "source")
    manifest = table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("hash"))
    return inbox.unseen(files, manifest).select("hash", F.col("path").alias("doc_id"), "source")


def ingest_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of documents, each tried again after what looks like a failure: what the tables of records and of the manifest then hold."""
    folder = f"{shared_folder(spark)}/quillframe-ingest-{uuid.uuid4().hex}"
    files = table(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.col("doc_id").cast("string").alias("path"), "text", "lang")
    finish = lambda rows: rows.withColumn("status", F.when(F.length("text") > 0, "processed").otherwise("failed"))
    for name, batch in (("a", files.where("lang in ('en', 'de')")), ("a", files.where("lang in ('en', 'de')")), ("b", files), ("b", files)):
        inbox.record_batch(batch, name, f"{folder}/manifest", f"{folder}/records", finish)
    known = inbox.read_manifest(spark, f"{folder}/manifest").select("hash", "batch", "status")
    records = spark.read.parquet(f"{folder}/records").groupBy("hash").agg(F.count(F.lit(1)).alias("records"))
    return known.join(records, "hash").select("hash", "batch", "status", "records")


def _fresh_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/quillframe-{what}-{uuid.uuid4().hex}"


def ingest_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken as one batch, and those that have labels taken again by force: what the manifest says of each content, and which batch its records are from."""
    folder = _fresh_folder(spark, "forced")
    files = table(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.col("doc_id").cast("string").alias("path"), "text", "doc_id")
    again = files.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    finish = lambda rows: rows.select("hash", "path", F.lit("processed").alias("status"))
    for name, batch, force in (("a", files, False), ("b", again, False), ("forced-1", again, True)):
        inbox.record_batch(batch, name, f"{folder}/manifest", f"{folder}/records", finish, force)
    manifest = inbox.read_manifest(spark, f"{folder}/manifest")
    rows = inbox.current(spark.read.schema("hash string, path string, status string, batch string").parquet(f"{folder}/records"), manifest)
    tries = manifest.groupBy("hash").agg(F.count(F.lit(1)).alias("tries"))
    return rows.join(tries, "hash").select("hash", "path", "batch", "tries")


def snapshot_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, then customers (twice, as after a failure), inserted where their number is absent, and nations by force: what is stored under each number."""
    path = f"{_fresh_folder(spark, 'snapshots')}/cases"
    rows = lambda name, key, body: table(spark, sf_dir, name).select(F.col(key).cast("long").alias("number"), F.col(body).alias("body"))
    suppliers, customers, nations = rows("supplier", "s_suppkey", "s_name"), rows("customer", "c_custkey", "c_name"), rows("nation", "n_nationkey", "n_name")
    for name, batch, force in (("s", suppliers, False), ("c", customers, False), ("c", customers, False), ("n", nations, True)):
        snapshots.insert_absent(batch, path, "number", name, force=force)
    return snapshots.read_snapshots(spark, path, "number long, body string", "number").select("number", "body", F.element_at(F.split("batch", "-"), -1).alias("batch"))


def _write_files(rows: DataFrame) -> int:
    """One file for each row (path, content), written by the tasks; returns how many."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                store, place = pyarrow.fs.FileSystem.from_uri(path)
                store.create_dir(place.rpartition("/")[0], recursive=True)
                with store.open_output_stream(place) as out:
                    out.write(content.encode("utf-8"))
            yield batch[["path"]]

    return rows.select("path", "content").mapInPandas(run, "path string").count()


def archive_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each supplier, named by its nation, in an inbox of many folders, moved to an archive that holds a file for each nation; then again, as after a failure: where every content lies."""
    folder = moves.address(_fresh_folder(spark, "archive"))
    k = F.col("s_suppkey")
    name = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(".txt"))
    files = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit(f"{folder}/inbox/"), F.lpad(k.cast("string"), 12, "0"), F.lit("/"), name).alias("path"), F.col("s_name").alias("content"), F.sha2("s_name", 256).alias("hash"), F.when(F.col("s_acctbal") < 0, "failed").otherwise("processed").alias("target")
    )
    held = table(spark, sf_dir, "nation").select(F.concat(F.lit(f"{folder}/archive/processed/n"), F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("path"), F.col("n_name").alias("content"))
    _write_files(held.unionByName(files.select("path", "content")))
    for _ in range(2):
        moved = moves.archive(files.select("hash", "path", "target"), {t: f"{folder}/archive/{t}" for t in ("processed", "failed")}, f"{folder}/log", "a")
    found = spark.read.text(f"{folder}/archive", wholetext=True, recursiveFileLookup=True).select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:///").alias("archived_path"), F.col("value").alias("content"))
    rows = moved.join(found, "archived_path")
    return rows.select(F.regexp_extract("path", r"/(\d{12})/", 1).cast("long").alias("s_suppkey"), "target", F.element_at(F.split("archived_path", "/"), -1).alias("archived_name"), "state", "content")


def inbox_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("hash"), F.col("doc_id").alias("path"), "source")
    manifest = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("hash"))
    return inbox.unseen(files, manifest).select(F.col("path").alias("doc_id"), "source")


def source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one length as one case, found in three folders that their sources are dealt to."""
    folder = F.concat(F.lit("src"), (F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("int"), F.lit(0)) % 3).cast("string")).alias("source")
    rows = table(spark, sf_dir, "documents").select((F.col("n_chars") % 97).alias("key"), folder, F.col("doc_id").alias("payload"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("path"))
    best = catalog.pick_source(rows, "key", "source", ["payload"], ["src2", "src0", "src1"], "path")
    return best.select("key", "source", F.col("payload").alias("doc_id"))


def overlay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "documents").select((F.col("doc_id") * 2).alias("doc_id"), F.lit(0).alias("quality"), F.lit(0).alias("toxic"), "source")
    edits = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 1).alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    return catalog.overlay(base, edits, "doc_id", ["quality", "toxic"]).select("doc_id", F.coalesce(_long("quality"), F.lit(-1)).alias("quality"), F.coalesce(_long("toxic"), F.lit(-1)).alias("toxic"), "source", "overlaid", "added")


def last_wins_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(T.url_key(F.regexp_extract("url", r"^([^/]*//[^/]*/[^/]*)", 1)).alias("place"), "page_id", "url")
    return catalog.last_wins(rows, ["place"], ["page_id"], ["page_id", "url"])


def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat search rows of the suppliers' records."""
    k = F.col("s_suppkey")
    title = F.when(k % 4 == 0, "Putusan").when(k % 4 == 1, "").when(k % 4 == 2, F.concat(F.lit("Judul "), F.col("document.case_number")))
    group = F.lit(None).cast("array<struct<heading:string,text:string>>")
    records = validate.with_parser(validate.with_validation(_verdict_records(spark, sf_dir))).select(
        "s_suppkey", F.concat(F.lit("c"), k.cast("string")).alias("case_id"), F.lit("parsed_json").alias("route_source"), F.struct(F.lit(None).cast("string").alias("file_name")).alias("source"),
        F.col("document").withField("title", title).withField("summary", F.lit(None).cast("string")).alias("document"),
        F.col("legal_basis").withField("object_of_review", F.when(k % 3 == 0, F.array(F.lit("UU 1"))).otherwise(F.array().cast("array<string>"))).alias("legal_basis"), "outcome", "parser", "validation", "parties", group.alias("sections"),
    )
    return catalog.summarize(records).select("case_id", "title", "law", "year", "description", "status", "needs_manual_review", "applicant_count", "outcome_key", "file_name")


def catalog_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view of all documents, refreshed after labelled poor ones went, benchmark passages replaced texts of their number, and customers came: its rows, and the refresh that made each."""
    path = _fresh_folder(spark, "view")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    poor = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("passage"))
    later = docs.join(poor, "doc_id", "left_anti").join(passages, "doc_id", "left").select("key", F.coalesce("passage", "text").alias("text"))
    later = later.unionByName(table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("text")))
    for refresh, rows in ((1, docs.select("key", "text")), (2, later), (3, later)):
        views.refresh(rows, "key", F.sha2("text", 256), path, lambda r, n=refresh: r.select("key", F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"), F.lit(n).cast("long").alias("made_by")))
    return views.read_view(spark, path, "key string, chars long, text_md5 string, made_by long")


def translate_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts composed of the parts' brands and types, translated by a dictionary of these."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name", F.col("p_size").cast("string").alias("p_size"))
    dictionary = parts.select(F.col("p_brand").alias("source"), F.concat(F.lit("brand "), "p_brand").alias("target")).union(parts.select("p_type", F.lower("p_type"))).distinct()
    b, t, n, z = (F.col(c) for c in ("p_brand", "p_type", "p_name", "p_size"))
    lit = F.lit
    texts = [
        F.concat(lit("Disusun dari: "), t, lit(".")), F.concat(t, lit(" · teks asli")), F.concat(lit("Sama-sama membahas "), b, lit(", "), t, lit(", "), n), F.concat(b, lit(": "), t, lit(" · ABCD")),
        F.concat(lit("  Hapus "), b, lit(": · "), z, lit(" perkara → ")), F.concat(n, lit(": "), t), F.concat(n, lit(", 5 Mei 2020 · Putusan")), F.concat(lit("· "), b, lit(": Halaman "), z, lit(" ↗")),
    ]
    rows = parts.select("p_partkey", F.posexplode(F.array(*texts)).alias("kind", "text"))
    return catalog.translate_composite(rows, "text", dictionary, "english").select("p_partkey", _long("kind").alias("kind"), "english")


def universal_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("slug"), (F.col("conv_id") * 7 + F.col("turn") * STORY_STEP).alias("case_number"))
    cases = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_number"))
    return stories.complete_stories(entries.select("slug").distinct(), entries, cases).select(F.col("slug").alias("conv_id"))


def story_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") + F.col("turn")).alias("case_number"))
    cases = table(spark, sf_dir, "documents").select((F.col("doc_id") % 300).alias("case_number"), F.col("doc_id").alias("pos"), "lang")
    return stories.story_entries(entries, cases).select("conv_id", "turn", "case_number", "lang")


def story_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stories.neighbours(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")
    return rows.select("conv_id", "turn", _long("number").alias("number"), "entries", F.col("previous").alias("previous_role"), F.col("next").alias("next_role"))


def chapter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("chapter"))
    groups = entries.select("conv_id").distinct().withColumn("chapter", F.explode(F.array(*map(F.lit, ["user", "assistant", "epilogue"]))))
    return stories.chapters(entries, groups, "conv_id")


def vote_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    judges = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    positions = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("position"))
    return stories.tally(stories.with_positions(judges, positions, ["conv_id", "turn"], ["user", "assistant"]), ["conv_id"])


def orphan_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("hash"), "source")
    drafts = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_hash"))
    cases = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 2).alias("document_hash"))
    return library.orphan_files(files, drafts, cases).select(F.col("hash").alias("doc_id"), "source")


def insight_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as insights about cases, with changes, reasons, thresholds and positions: every page they cite."""
    k = F.col("c_custkey").cast("int")
    person = F.struct(F.col("c_name").alias("name"), F.when(k % 3 == 0, k % 50).alias("page"))
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(k % 2 == 0, F.struct(F.lit("a").alias("before"), F.lit("b").alias("after"), (k % 9).alias("page"), F.when(k % 4 == 0, F.array(k % 7, k % 5)).alias("pages"))).alias("change"),
        F.transform(F.sequence(F.lit(1), k % 4 + 1), lambda i: F.struct(F.lit("x").alias("title"), (i * 2).alias("page"))).alias("reasoning"),
        F.when(k % 5 == 0, F.struct((k % 11).alias("page"), F.array(F.array(F.lit("1"))).alias("rows"))).alias("thresholds"),
        F.struct(F.lit(None).cast("int").alias("page"), F.array(person, person).alias("positions")).alias("court"),
    )
    return stories.citations(rows, "c_custkey").select("c_custkey", "part", _long("pos").alias("pos"), _long("page").alias("page"), "label")


def party_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of a nation's customers, each once whatever its case, in the order they first come: only distinct names of a nation meet."""
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.initcap("c_mktsegment")).otherwise(F.col("c_mktsegment")), F.lit(" "), (F.col("c_custkey") % 3).cast("string"))
    people = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", name.alias("name"))
    first = people.groupBy("c_nationkey", F.lower("name").alias("_k")).agg(F.min("c_custkey").alias("at"), F.min_by("name", "c_custkey").alias("name"))
    names = first.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("x"))
    return names.select(_long("c_nationkey").alias("c_nationkey"), F.array_join(T.ordered_distinct(F.transform("x", lambda p: p["name"]), F.lower), "; ").alias("names"))


def revision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("revision"), "event_type", (F.col("event_type") == "signup").alias("deleted"))
    return library.current(log).select("id", "revision", "event_type")


def save_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 3).alias("revision"), F.col("s_name").alias("case_number"), F.lit("putusan").alias("document_type"))
    changes = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1).alias("id"), (F.col("s_suppkey") % 2).alias("revision"), F.when(F.col("s_suppkey") % 5 == 0, F.col("s_name")).otherwise(F.concat("s_name", F.lit("x"))).alias("case_number"), F.lit("putusan").alias("document_type"))
    return library.conflicts(changes, state)


def save_conflicts_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as new cases, saved in one batch: those of one brand, size and type would be one case."""
    state = table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("id"), F.lit(1).alias("revision"), F.col("s_name").alias("case_number"), F.lit("x").alias("document_type"))
    changes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(0).alias("revision"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("case_number"), F.col("p_type").alias("document_type"))
    return library.conflicts(changes, state)


def publish_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of suppliers' cases and of new ones, with the owner's fields: what publishing changes, and which of it conflicts with the state."""
    k = F.col("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier")
    cases = suppliers.select(F.concat(F.lit("case-"), k.cast("string")).alias("id"), (k % 3).alias("revision"), F.col("s_name").alias("case_number"), F.lit("p").alias("document_type"), F.concat(F.lit("h"), k.cast("string")).alias("document_hash"), F.concat(F.lit("e"), k.cast("string")).alias("edits"))
    known = cases.select(F.col("id").alias("case_id"), "document_hash", "case_number", "document_type", F.lit(None).cast("string").alias("raw_number"), F.lit(None).cast("string").alias("raw_type"))
    n = F.col("c_custkey")
    uploads = table(spark, sf_dir, "customer").select(F.concat(F.lit("d"), n.cast("string")).alias("draft_id"), F.when(n % 7 == 0, F.concat(F.lit("case-"), n.cast("string"))).alias("target_id"), F.concat(F.lit("h"), n.cast("string")).alias("document_hash"), F.col("c_name").alias("case_number"), F.lit("p").alias("document_type"), F.lit("{}").alias("record"), F.lit(None).cast("timestamp").alias("created_at"))
    drafts, errors = library.staged(uploads, known, cases)
    fields = drafts.select(F.col("id").alias("draft_id"), F.concat(F.lit("Supplier #"), F.substring("document_hash", 2, 1)).alias("case_number"), F.lit("p").alias("document_type"), F.when(F.col("target").startswith("case-1"), "own").alias("edits"))
    changes = library.published(drafts, fields)
    made = changes.select("draft_id", F.when(F.col("revision") + F.length("edits") > 0, F.col("id")).alias("target"), _long("revision").alias("revision"), "case_number", "edits", F.lit("").alias("error"))
    empty = F.lit(None).cast("string")
    return made.union(errors.select("draft_id", empty, F.lit(None).cast("long"), empty, empty, "error"))


def target_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("case-"), F.col("s_suppkey").cast("string")).alias("case_id"), F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("h"), F.col("s_suppkey").cast("string"))).alias("document_hash"), F.col("s_name").alias("case_number"), F.lit("p").alias("document_type"), F.concat(F.lit("old"), (F.col("s_suppkey") % 20).cast("string")).alias("raw_number"), F.lit("p").alias("raw_type"))
    k = F.col("p_partkey")
    drafts = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 6 == 0, F.concat(F.lit("case-"), k.cast("string"))).alias("target_id"), F.concat(F.lit("h"), k.cast("string")).alias("document_hash"), F.concat(F.lit("old"), (k % 40).cast("string")).alias("case_number"), F.lit("p").alias("document_type"))
    return library.resolve_targets(drafts, known).select("p_partkey", "target", _long("candidates").alias("candidates"))


def new_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_number"), F.col("o_orderstatus").alias("document_type"))
    known = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_number"), F.col("l_linestatus").alias("document_type"))
    return library.new_entries(manifest, known).select(F.col("case_number").alias("o_orderkey"), F.col("document_type").alias("o_orderstatus"))


def import_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    manifest = table(spark, sf_dir, "part").select("p_partkey", F.concat(k.cast("string"), F.lit(".pdf")).alias("file_name"), F.sha2(k.cast("string"), 256).alias("sha256"), F.col("p_name").alias("case_number"))
    n = F.col("c_custkey") * 2
    files = table(spark, sf_dir, "customer").select(F.concat(n.cast("string"), F.lit(".pdf")).alias("file_name"), F.sha2(F.when(n % 7 == 0, "x").otherwise(n.cast("string")), 256).alias("hash"))
    parsed = table(spark, sf_dir, "part").select(F.concat(k.cast("string"), F.lit(".pdf")).alias("file_name"), F.when(k % 11 == 0, "?").otherwise(F.col("p_name")).alias("case_number"))
    good, bad = library.import_batch(manifest, files, parsed)
    return good.select("p_partkey", F.lit("").alias("reason")).union(bad.select("p_partkey", "reason"))


def archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select(F.lit("processed").alias("target"), F.concat("p_brand", F.lit(".pdf")).alias("file_name"), F.col("p_partkey").alias("path"))
    taken = table(spark, sf_dir, "customer").groupBy(F.lit("processed").alias("target"), F.concat(F.lit("Brand#"), F.col("c_nationkey").cast("string"), F.lit(".pdf")).alias("file_name")).agg(F.count(F.lit(1)).alias("n"))
    return sinks.archive_names(files, taken).select(F.col("path").alias("p_partkey"), "archived_name")


# --- Pages


def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html.strip_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(text).cast("long").alias("chars"), F.md5(text.cast("binary")).alias("text_md5"))


def html_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html.clean_lines(html.markup_to_lines(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", F.length(text).cast("long").alias("chars"), F.size(T.lines(text)).cast("long").alias("lines"))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.anchors(F.col("html"))).alias("pos", "a"))
    return rows.select("page_id", _long("pos").alias("pos"), "a.href", "a.title")


def link_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = T.document_category(F.lit("pdf"), F.regexp_replace(F.regexp_replace("url", "/de/", "/download.putusan/"), "/fr/", "/audio/"))
    return table(spark, sf_dir, "pages").groupBy(kind.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def page_link_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_links(table(spark, sf_dir, "pages"), "page_id").select("page_id", _long("pos").alias("pos"), "title", "url", "category", "file_name")


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.url_key(F.col("url")).alias("url_key"), T.file_name_of_url(F.col("url")).alias("file_name"))


# --- Streams


def miss_run_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "view", "miss").when(F.col("event_type") == "error", "stop").otherwise("hit")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", outcome.alias("outcome"))
    return inbox.miss_scan(rows, ["user_id"], "event_id", "outcome", SCAN_MOST, SCAN_MISSES).select("user_id", "event_id", "outcome", "misses")


def scan_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbox.checkpoint(miss_run_scan(spark, sf_dir), ["user_id"], "event_id").select("user_id", "last_checked", "next", "consecutive_misses")


def inbox_stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream, taken once to the end; the distinct (user, type) pairs are kept in stream state."""
    name = f"{shared_folder(spark)}/quillframe-stream-{uuid.uuid4().hex}"
    schema: StructType = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    seen = inbox.dedupe_stream(events, ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type")
    query = seen.writeStream.format("parquet").option("path", f"{name}/out").option("checkpointLocation", f"{name}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(seen.schema).parquet(f"{name}/out")


def sync_and_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user as responses to numbered requests, synced in two runs whose hits are stored and ingested: where each user's scan stands, and what came of it."""
    folder = _fresh_folder(spark, "sync")
    schema: StructType = table(spark, sf_dir, "events").schema
    outcome = F.when(F.col("event_type") == "view", "miss").when(F.col("event_type") == "error", "stop").otherwise("hit")
    for _ in range(2):
        responses = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select("user_id", F.col("event_id").alias("sequence"), outcome.alias("outcome"), F.col("props").alias("body"))
        jobs.sync_and_ingest(responses, folder, "user_id", lambda rows: rows.select("hash", "path", F.lit("processed").alias("status")), SCAN_MOST, SCAN_MISSES)
    looked = sync.read_looked(spark, f"{folder}/scan", "user_id", "bigint").groupBy("user_id").agg(F.count(F.lit(1)).alias("looked"), F.count_if(F.col("outcome") == "hit").alias("hits"))
    owner = F.split("path", "/")[0].cast("long").alias("user_id")
    stored = snapshots.read_snapshots(spark, f"{folder}/snapshots", "path string, text string", "path").select(owner).groupBy("user_id").agg(F.count(F.lit(1)).alias("snapshots"))
    records = spark.read.parquet(f"{folder}/records").select(owner).groupBy("user_id").agg(F.count(F.lit(1)).alias("records"))
    rows = sync.read_state(spark, f"{folder}/scan", "user_id", "bigint").join(looked, "user_id").join(stored, "user_id", "left").join(records, "user_id", "left")
    return rows.select("user_id", "last_checked", "next", "consecutive_misses", "looked", "hits", F.coalesce("snapshots", F.lit(0)).alias("snapshots"), F.coalesce("records", F.lit(0)).alias("records"))


#: A ruling as text; the fields in braces are filled from a customer's row.
RULING = """PUTUSAN
Nomor {number}
MAHKAMAH KONSTITUSI REPUBLIK INDONESIA
permohonan Pengujian Undang-Undang Nomor {law} Tahun 2010 tentang Hal {law} terhadap Undang-Undang Dasar 1945 yang diajukan oleh:
1. Nama : {name}
Pekerjaan : Swasta
2. Nama : {second}
Pekerjaan : Swasta
dengan ini memberi kuasa kepada Budi {segment}, S.H., Siti Aminah;
DUDUK PERKARA
Menimbang bahwa Pemerintah dan DPR telah didengar. Bukti P-{law} dan bukti P-{law} diajukan.
Menimbang Putusan Nomor {cited} dan Pasal {article} ayat (1) UUD 1945.
Sesuai Pasal {law} Peraturan Mahkamah Konstitusi.
Mendengar keterangan ahli dalam sidang pleno.
AMAR PUTUSAN
Mengadili:
1. {verdict}
permohonan {segment};
2. Memerintahkan pemuatan putusan ini.
Demikian diputus dalam rapat yang diucapkan pada hari Senin, tanggal {date}.
KETUA,
ttd.
Andi Wijaya
Rina {initial}artono
PANITERA PENGGANTI,
ttd.
Dewi Lestari
"""


def _rulings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, months = F.col("c_custkey"), F.array(*[F.lit(m) for m in T.MONTHS])
    year = k % 20 + 2004
    values = {
        "number": T.build_case_number(k % 200 + 1, F.lit("PUU"), year), "law": (k % 30 + 1).cast("string"), "name": F.col("c_name"), "second": F.when(k % 3 == 0, F.upper("c_name")).otherwise(F.concat(F.lit("Ibu "), "c_mktsegment")), "segment": F.initcap("c_mktsegment"),
        "cited": T.build_case_number(k % 7 + 300, F.lit("PUU"), F.lit(2019)), "article": (k % 5 + 20).cast("string"), "verdict": F.when(k % 2 == 0, "Menolak").otherwise("Mengabulkan"), "initial": F.when(k % 4 == 0, "H").otherwise("K"),
        "date": F.concat_ws(" ", (k % 28 + 1).cast("string"), F.get(months, (k % 12).cast("int")), year.cast("string")),
    }
    text = F.lit(RULING)
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return _spread(table(spark, sf_dir, "customer"), "c_custkey").select(k.cast("string").alias("file_name"), text.alias("text"))


def ruling_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rulings written from customers' rows and read back by all extractors."""
    names = lambda c: F.array_join(F.transform(F.col(c), lambda p: p["name"]), "; ")
    joined = lambda c: F.array_join(c, "; ")
    records = extract.parse_documents(_rulings(spark, sf_dir))
    return records.select(
        F.col("source.file_name").cast("long").alias("c_custkey"), "document.document_type", "document.case_type", "document.case_number", "document.title", "document.decision_date",
        names("parties.applicants").alias("applicants"), names("parties.legal_counsels").alias("counsels"), names("parties.respondents").alias("respondents"), joined("legal_basis.object_of_review").alias("objects"),
        joined("legal_basis.constitutional_articles").alias("constitutional"), joined("legal_basis.procedural_articles").alias("procedural"), joined("legal_basis.evidence").alias("evidence"), joined("proceedings").alias("proceedings"),
        joined("outcome.dictum").alias("dictum"), F.col("outcome.summary").alias("summary"), joined("adjudicators.judges").alias("judges"), joined("adjudicators.clerks").alias("clerks"), joined("relations.referenced_cases").alias("cases"),
        F.size("sections").cast("long").alias("n_sections"), "parser.status", joined("validation.review_flags").alias("flags"),
    )


#: An order as text: applicants in a clause, experts, witnesses, amici, a reviewed clause, an order with a dissent after it, a date in words.
DECREE = """KETETAPAN
Nomor {number}
permohonan bertanggal 3 Maret 2019 dari {name}, yang diajukan melalui {segment}
amicus curiae dari Lembaga {segment};
DUDUK PERKARA
Objek uji: Pasal {law} UUD 1945
Mendengar keterangan ahli sebagai berikut
Nama : Ahli {segment}
Pekerjaan : Dosen
Mendengar keterangan saksi sebagai berikut
Nama : Saksi {witness}
Pekerjaan : Petani
MENETAPKAN:
1. Menyatakan permohonan {segment} ditarik kembali;
2. Memerintahkan pencatatan
perkara ini.
PENDAPAT BERBEDA
Hakim {segment} berpendapat lain.
Demikian ditetapkan dalam rapat yang diucapkan pada tanggal {day}, bulan {month}, tahun {year}
KETUA,
Andi Wijaya
"""
DAYS = ["satu", "dua", "tiga", "empat", "lima", "enam", "tujuh", "sepuluh", "sebelas", "dua belas", "dua puluh", "dua puluh satu"]
YEARS = ["dua ribu lima", "dua ribu dua puluh satu", "2019"]


def decree_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written from customers' rows and read back by the extractors: the people of all roles, the reviewed clause, the date in words and the dictum."""
    k, pick = F.col("c_custkey"), lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), (F.col("c_custkey") % n).cast("int"))
    values = {
        "number": T.build_case_number(k % 200 + 1, F.lit("PUU"), k % 20 + 2004), "law": (k % 30 + 1).cast("string"), "name": F.col("c_name"), "segment": F.initcap("c_mktsegment"),
        "witness": F.when(k % 2 == 0, "Hana").otherwise("Rina Dewi"), "day": pick(DAYS, len(DAYS)), "month": pick(T.MONTHS, 7), "year": pick(YEARS, len(YEARS)),
    }
    text = F.lit(DECREE)
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    records = extract.parse_documents(_spread(table(spark, sf_dir, "customer"), "c_custkey").select(k.cast("string").alias("file_name"), text.alias("text")))
    names = lambda c: F.array_join(F.transform(F.col(f"parties.{c}"), lambda p: p["name"]), "; ").alias(c)
    return records.select(
        F.col("source.file_name").cast("long").alias("c_custkey"), "document.document_type", "document.decision_date", "document.decision_date_raw", *[names(c) for c in ("applicants", "experts", "witnesses", "amicus_curiae")],
        F.array_join("legal_basis.object_of_review", "; ").alias("objects"), F.array_join("proceedings", "; ").alias("proceedings"), F.array_join("outcome.dictum", "; ").alias("dictum"), F.array_join("adjudicators.judges", "; ").alias("judges"),
    )


def parse_rulings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document read as a ruling: the extractors run over whole texts, and the checks tell what they lack."""
    records = extract.parse_documents(_spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(F.col("doc_id").cast("string").alias("file_name"), "text"))
    return records.select(
        F.col("source.file_name").alias("file_name"), "parser.status", F.size("sections").cast("long").alias("sections"), F.array_join("validation.review_flags", ",").alias("flags"), F.array_join("validation.business_rule_errors", ",").alias("errors"),
        F.col("outcome.summary").alias("summary"), F.size("parties.applicants").cast("long").alias("applicants"), F.size("relations.referenced_cases").cast("long").alias("cases"),
    )
