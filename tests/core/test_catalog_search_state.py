import importlib
import sys

import pytest
from pyspark.sql import functions as F

from quillframe.functions.search_text import Query, read_query
from quillframe.operators import catalog, extract, html, library, reports, search, stories, validate
from quillframe.sources import readers, sinks
from quillframe.streaming import inbox

RECORD = readers.RECORD


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- Catalog


def test_the_strongest_source_wins(spark):
    df = spark.createDataFrame([("a", "parsed_json", 1, "p/a"), ("a", "review_queue", 2, "r/a"), ("b", "validated_json", 3, "v/b"), ("c", "other", 4, "o/c")], "case_id string, source string, payload int, path string")
    out = {r.case_id: r for r in catalog.pick_source(df, "case_id", "source", ["payload"], path="path").collect()}
    assert out["a"].payload == 2 and out["a"].available == {"parsed_json": "p/a", "review_queue": "r/a"} and out["b"].source == "validated_json" and "c" not in out


def test_overlay_and_last_wins(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, f string, g string")
    edits = spark.createDataFrame([(2, "B"), (3, "C"), (1, None)], "id int, f string")
    assert rows(catalog.overlay(base, edits, "id", ["f"]), "id", "f", "overlaid", "added") == [(1, "a", True, False), (2, "B", True, False), (3, "C", True, True)]
    log = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 9, "only")], "k string, n int, v string")
    assert rows(catalog.last_wins(log, ["k"], ["n"], ["v"]), "k", "v") == [("j", "only"), ("k", "new")]


TEXT = "PUTUSAN\nNomor 31/PUU-XIX/2021\nNama : Rina\nPekerjaan : Guru\nDUDUK PERKARA\nPasal 1 UUD 1945\nAMAR PUTUSAN\n1. Menolak\nDemikian diputus, diucapkan 4 Mei 2022\nKETUA,\nHakim A\n"


@pytest.fixture(scope="module")
def records(spark):
    docs = spark.createDataFrame([("a.txt", TEXT), ("b.txt", "KETETAPAN\nbatu bara")], "file_name string, text string")
    return extract.parse_documents(docs).withColumns({"case_id": F.regexp_replace("source.file_name", r"\.txt$", ""), "route_source": F.lit("parsed_json")}).cache()


def test_summaries(spark, records):
    noted = records.withColumn("editorial", F.when(F.col("case_id") == "a", F.struct(F.lit("Judul").alias("title"), F.lit("Ringkas").alias("summary"), F.array(F.lit("pemilu"), F.lit("ham")).alias("topics"), F.lit("UU Pemilu").alias("law"))))
    out = {r.case_id: r for r in catalog.summarize(noted, spark.createDataFrame([("pemilu", "election")], "source string, target string")).collect()}
    a, b = out["a"], out["b"]
    assert (a.title, a.description, a.topics, a.law, a.editorial, a.outcome_key, a.outcome_label, a.year) == ("Judul", "Ringkas", ["pemilu", "ham"], "UU Pemilu", True, "rejected", "Ditolak", "2022")
    assert a["_english_search_text"] == "election" and b["_english_search_text"] == "" and "batubara" in b["_normalized_search_text"]
    assert b.title == "Perkara b" and b.description.startswith("ketetapan tidak") and b.topics == [] and b.year == ""
    public = catalog.public(catalog.summarize(records))
    assert not [c for c in public.columns if c.startswith("_")]


def test_corrections_replace_facts_and_recheck(spark, records):
    edits = "struct<case_number:string,document_type:string,decision_date:string,applicants:array<string>,judges:array<string>,clerks:array<string>,dictum:array<string>>"
    given = F.from_json(F.lit('{"applicants": ["Baru"], "dictum": ["Mengabulkan"], "judges": ["H"]}'), edits)
    out = catalog.apply_corrections(records.withColumns({"edits": given, "edited": F.when(F.col("case_id") == "a", F.array(*map(F.lit, ["applicants", "dictum", "decision_date"])))}))
    a, b = (out.where(F.col("case_id") == k).first() for k in "ab")
    assert [p["name"] for p in a.parties["applicants"]] == ["Baru"] and a.outcome["summary"] == "Mengabulkan" and a.adjudicators["judges"] == ["Hakim A"]
    assert a.document["decision_date"] is None and "decision_date_missing" in a.validation["review_flags"] and a.parser["status"] == "ok"
    assert b.validation["review_flags"] == records.where("case_id = 'b'").first().validation["review_flags"]


def test_download_urls(spark, records):
    manifests = spark.createDataFrame([("1.json", 0, "31 / PUU-XIX / 2021", None, "old"), ("2.json", 0, "31/PUU-XIX/2021", "putusan", "new")], "file string, idx int, case_number string, document_type string, url string")
    assert rows(catalog.fill_download_url(records, manifests), "case_id", "source.download_url") == [("a", "new"), ("b", None)]
    assert rows(catalog.translate(spark.createDataFrame([("ham",), ("x",)], "t string"), "t", spark.createDataFrame([("ham", "rights")], "source string, target string"), "e"), "t", "e") == [("ham", "rights"), ("x", "x")]


# --- Search


FLAT = "case_id string, case_number string, title string, topics array<string>, decision_date string, status string, document_type string, needs_manual_review boolean, review_flags array<string>, year string, _normalized_search_text string, _english_search_text string"


@pytest.fixture(scope="module")
def flat(spark):
    return spark.createDataFrame(
        [
            ("a", "7/PUU-XXI/2023", "Pemilu raya", ["pemilu", "ham"], "2023-05-01", "ok", "putusan", False, [], "2023", "pemilu raya suara", "election vote"),
            ("b", "17/PUU-XXI/2023", "Hak asasi", ["ham"], None, "partial", None, True, ["x", "y"], "", "hak asasi manusia", ""),
            ("c", None, "Pajak", ["pajak"], "2024-01-01", None, "ketetapan", True, ["x"], "2024", "pajak pemilu", "tax"),
        ],
        FLAT,
    )


def test_filters(flat):
    ids = lambda df: "".join(sorted(r.case_id for r in df.collect()))
    assert ids(search.filter_rows(flat)) == "abc"
    assert ids(search.filter_rows(flat, read_query("pemilu"))) == "ac" and ids(search.filter_rows(flat, read_query("pemilu suara"))) == "a" and ids(search.filter_rows(flat, read_query("election"))) == "a"
    assert ids(search.filter_rows(flat, read_query("7/2023"))) == "a" and ids(search.filter_rows(flat, read_query("nomor 17/PUU-XXI/2023"))) == "b"
    assert ids(search.filter_rows(flat, equal={"status": "ok", "year": ""})) == "a" and ids(search.filter_rows(flat, member={"topics": "ham", "review_flags": "y"})) == "b"
    assert ids(search.filter_rows(flat, review_only=True)) == "bc"


def test_ranking(flat):
    fields = [search.Field("Judul", F.col("title"), F.lower("title"), 50), search.Field("Teks", F.col("_normalized_search_text"), F.col("_normalized_search_text"), 1), search.Field("Title", F.col("_english_search_text"), F.col("_english_search_text"), 20, True)]
    out = {r.case_id: r for r in search.rank(flat, fields, ["pemilu", "suara"]).collect()}
    assert out["a"].relevance == 50 + 2 + 1 and out["a"].match_label == "Teks" and out["c"].relevance == 1 and out["b"].match_label is None
    out = {r.case_id: r for r in search.rank(flat, fields, ["election"], F.col("case_id") == "b").collect()}
    assert out["a"].match_translated and out["b"].relevance == 1000 and out["b"].match_excerpt == "17/PUU-XXI/2023"
    twice = {r.case_id: r.relevance for r in search.rank(flat, fields, ["pemilu", "pemilu"]).collect()}
    assert twice["a"] == 3 * 50 + 3 * 1


def test_excerpt(spark):
    text = "a" * 100 + "needle" + "b" * 300
    got = spark.range(1).select(search.excerpt(F.lit(text), ["needle"]).alias("e"), search.excerpt(F.lit("short"), ["zz"]).alias("f")).first()
    assert got.e == "…" + text[25:265] + "…" and got.f == "short"


@pytest.mark.parametrize("order,want", [("newest", "cab"), ("oldest", "acb"), ("review_priority", "bca"), ("status", "bac"), ("nonsense", "bca"), ("case_number", "bac")])
def test_orders(flat, order, want):
    df = flat.withColumn("relevance", F.lit(0))
    assert "".join(r.case_id for r in search.page(df, search.order_of(order, F.col("case_id")), 1).collect()) == want


def test_paging_and_facets(spark, flat):
    assert [search.page_number(t, 45) for t in ("", "2", "99", "-1", "x")] == [1, 2, 3, 1, 1]
    assert [r.id for r in search.page(spark.range(45), [F.col("id")], 3).collect()] == list(range(40, 45))
    got = {(r.facet, r.value): r.n for r in search.facets(flat).collect()}
    assert got[("status", "unknown")] == 1 and got[("document_type", "unknown")] == 1 and got[("review_flag", "x")] == 2 and got[("total", "")] == 3 and got[("needs_review", "")] == 2 and ("year", "") not in got
    assert search.default_order(Query(None, ())) == "newest" and search.default_order(read_query("x")) == "relevance"


def test_related(flat):
    assert rows(search.related(flat, "case_id", "topics", "decision_date"), "case_id", "rank", "other", "common") == [("a", 1, "b", "ham"), ("b", 1, "a", "ham")]


# --- Stories


def test_stories(spark):
    s = spark.createDataFrame([("full",), ("broken",), ("empty",)], "slug string")
    e = spark.createDataFrame([("full", 1, "n1"), ("full", 2, "n2"), ("broken", 1, "n1"), ("broken", 2, "n9")], "slug string, idx int, case_number string")
    c = spark.createDataFrame([("n1", 1, "A"), ("n1", 2, "B"), ("n2", 3, "C")], "case_number string, pos int, title string")
    assert rows(stories.complete_stories(s, e, c), "slug") == [("full",)]
    assert rows(stories.story_entries(e, c), "slug", "case_number", "title") == [("broken", "n1", "B"), ("full", "n1", "B"), ("full", "n2", "C")]
    assert rows(stories.neighbours(e.where("slug = 'full'"), "slug", "idx", "case_number"), "number", "entries", "previous", "next") == [(1, 2, None, "n2"), (2, 2, "n1", None)]
    got = spark.range(1).select(stories.split_dictum(F.array(*map(F.lit, "abc")), F.lit(1)).alias("d")).first()["d"]
    assert got["provisional"] == ["a"] and got["merits"] == ["b", "c"]
    judges = spark.createDataFrame([("k", "A"), ("k", "B"), ("k", "C")], "case string, name string")
    known = spark.createDataFrame([("k", "A", "dissenting"), ("k", "B", "absent")], "case string, name string, position string")
    assert rows(stories.tally(stories.with_positions(judges, known, ["case", "name"]), ["case"]), "position", "n") == [("dissenting", 1), ("unverified", 2)]


# --- Reports and routing


def test_reports_and_routes(spark, records):
    flat = records.select(F.col("source.file_name").alias("file_name"), "parser.status", "document.document_type", "validation.review_flags", "parser.failed_extractors", "validation.needs_manual_review")
    got = {(r.kind, r.value): r.n for r in reports.counts(flat, "parsed").collect()}
    assert got[("status", "ok")] == 1 and got[("document_type", "ketetapan")] == 1 and got[("file_count", "")] == 2
    assert rows(reports.listed_files(flat), "list", "file_name") == [("needing_review", "b.txt")]
    assert rows(reports.unfinished(flat), "file_name", "status") == [("b.txt", "partial")]
    staged = {(r.stage, r.kind): r.n for r in reports.stage_report(flat, flat.limit(0), flat).where("kind = 'file_count'").collect()}
    assert staged == {("parsed", "file_count"): 2, ("review_queue", "file_count"): 2}
    assert rows(validate.route(records), "case_id", "route") == [("a", "validated"), ("b", "review_queue")]


def test_manifest_and_uploads(spark):
    fine = ("1", "putusan", "https://f.example/a.pdf", "a.pdf", "0" * 64)
    df = spark.createDataFrame([fine, ("2", "putusan", "http://f.example/a.pdf", "../a.pdf", "z"), ("3", None, fine[2], "b.pdf", fine[4]), ("3", None, fine[2], "c.pdf", fine[4])], "case_number string, document_type string, url string, file_name string, sha256 string")
    got = {r.file_name: r.errors for r in validate.manifest_errors(df, ["f.example"]).collect()}
    assert got == {"a.pdf": [], "../a.pdf": ["url", "file name", "sha256"], "b.pdf": ["identity"], "c.pdf": ["identity"]}
    files = spark.createDataFrame([("x/a.PDF", 10, bytearray(b"%PDF-1.4")), ("b.txt", 99_000_000, bytearray(b"no"))], "path string, length long, content binary")
    good, bad = readers.split_uploads(files)
    assert rows(good, "path") == [("x/a.PDF",)] and bad.first()["errors"] == ["suffix", "size", "content"]


# --- Pages


PAGE = """<html><style>p{}</style><!-- x --><table><tr><td>No Perkara</td><td>7/PUU-XXI/2023</td></tr></table><p>Pokok : Uji&nbsp;UU</p>
<div>Pemohon</div><div>1. Andi</div><div>- ANDI</div><div>Bela</div><div>Kuasa Hukum : Citra</div><div>BERKAS</div><a href='/a/putusan.pdf?x=1&amp;y=2'><b>Putusan</b></a><a href="x.mp3"> </a><a href="/a/putusan.pdf?x=1&amp;y=2">PUTUSAN</a>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, "https://t.example/i?id=1", PAGE), (2, "https://t.example/", None), (3, "u", "<p>nothing")], "page_id int, url string, html string")
    text = {r.page_id: r.t for r in df.select("page_id", html.strip_html(F.col("html")).alias("t")).collect()}
    assert text[1].splitlines()[:2] == ["No Perkara : 7/PUU-XXI/2023", "Pokok : Uji UU"] and text[2] == "" and text[3] == "nothing"
    case = html.tracked_case(df, "page_id", {"number": "No Perkara", "title": "Pokok", "applicants": "Pemohon", "counsels": "Kuasa Hukum"}, ["Kuasa Hukum"]).collect()
    assert [(r.page_id, r.case_number, r.case_type, r.year, r.title, r.applicants, r.legal_counsels) for r in case] == [(1, "7/PUU-XXI/2023", "PUU", 2023, "Uji UU", ["1. Andi", "ANDI", "Bela"], ["Citra"])]
    links = html.page_links(df, "page_id").collect()
    assert [(r.title, r.url, r.category, r.file_name) for r in links] == [("Putusan", "https://t.example/a/putusan.pdf?x=1&y=2", "decision", "putusan.pdf")]


# --- Library and state


def test_revision_log(spark, tmp_path):
    log = spark.createDataFrame([("a", 1, False, "n1", "p"), ("a", 2, False, "n1", "p"), ("b", 1, True, "n2", "p")], "id string, revision int, deleted boolean, case_number string, document_type string")
    path = f"file://{tmp_path}/log"
    log.write.parquet(path)
    assert rows(library.current(log), "id", "revision") == [("a", 2)]
    library.save(log, spark.createDataFrame([("a", 2, False, "n3", "p")], log.schema), path)
    assert rows(library.current(spark.read.parquet(path)), "id", "revision", "case_number") == [("a", 3, "n3")]
    for change in (("a", 1, False, "n1", "p"), ("c", 0, False, "n1", "p")):
        with pytest.raises(library.ConflictError):
            library.save(log, spark.createDataFrame([change], log.schema), path)


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.append_new(df, path, ["k"])
    assert rows(sinks.append_new(spark.createDataFrame([(2, "B"), (3, "c")], df.schema), path, ["k"]), "k", "v") == [(1, "a"), (2, "b"), (3, "c")]
    files = spark.createDataFrame([("d", "x.pdf", "1"), ("d", "x.pdf", "2"), ("d", "y.pdf", "3")], "target string, file_name string, path string")
    taken = spark.createDataFrame([("d", "y.pdf", 1)], "target string, file_name string, n int")
    assert rows(sinks.archive_names(files, taken), "path", "archived_name") == [("1", "x.pdf"), ("2", "x__2.pdf"), ("3", "y__2.pdf")]
    routed = f"file://{tmp_path}/routed"
    sinks.write_routed(df.withColumn("route", F.lit("validated")), routed)
    sinks.write_routed(df.withColumn("route", F.lit("review_queue")), routed)
    assert rows(spark.read.parquet(routed), "k", "route") == [(1, "review_queue"), (2, "review_queue")]


def test_readers(spark, tmp_path, records):
    import json

    (tmp_path / "in" / "deep").mkdir(parents=True)
    record = json.loads(records.where("case_id = 'a'").toJSON().first())
    (tmp_path / "in" / "deep" / "k.json").write_text(json.dumps(record, indent=1))
    (tmp_path / "in" / "note.txt").write_text("x")
    got = readers.read_records(spark, f"file://{tmp_path}/in").collect()
    assert [(r.case_id, r.document["case_number"]) for r in got] == [("k", "31/PUU-XIX/2021")]
    assert readers.read_records(spark, f"file://{tmp_path}/none").count() == 0
    (tmp_path / "notes.json").write_text('{"31/PUU-XIX/2021": {"title": "T"}}')
    assert rows(readers.keyed_json(spark, f"file://{tmp_path}/notes.json", "title:string"), "case_number", "title") == [("31/PUU-XIX/2021", "T")]
    (tmp_path / "list.json").write_text('[{"u": "b"}, {"u": "a"}]')
    assert rows(readers.listed_json(spark, f"file://{tmp_path}/list.json", "u:string"), "idx", "u") == [(0, "b"), (1, "a")]


def test_inbox_takes_each_content_once(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    for name, text in (("1.txt", "A"), ("2.txt", "B"), ("3.txt", "A")):
        (box / name).write_text(text)
    where = {k: f"file://{tmp_path}/{k}" for k in ("box", "manifest", "records", "state")}

    def process(files):
        return files.withColumn("status", F.when(F.col("text") == "B", "failed").otherwise("processed"))

    def run():
        inbox.ingest_inbox(spark, where["box"], where["manifest"], where["records"], where["state"], process).awaitTermination()
        return rows(spark.read.parquet(where["manifest"]), "status")

    assert run() == [("failed",), ("processed",)]
    (box / "4.txt").write_text("B")
    (box / "5.txt").write_text("C")
    assert run() == [("failed",), ("processed",), ("processed",)]


def test_scan_in_batch_and_as_a_stream(spark, tmp_path):
    outcomes = ["hit", "miss", "hit", "miss", "miss", "hit", "stop", "hit"]
    data = [("k", i, o) for i, o in enumerate(outcomes)] + [("j", i, o) for i, o in enumerate(["hit", "stop", "hit"])]
    df = spark.createDataFrame(data, "key string, sequence long, outcome string")
    want = {"k": list(range(5)), "j": [0, 1]}
    got = inbox.miss_scan(df, ["key"], "sequence", "outcome", 50, 2)
    assert {k: sorted(r.sequence for r in got.collect() if r.key == k) for k in want} == want
    assert rows(inbox.checkpoint(got, ["key"], "sequence"), "key", "last_checked", "next", "consecutive_misses") == [("j", 1, 2, 0), ("k", 4, 5, 2)]
    df.write.parquet(f"file://{tmp_path}/in")
    stream = inbox.scan_stream(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in"), "key", 2)
    stream.writeStream.format("memory").queryName("scan").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert {k: sorted(r.sequence for r in spark.table("scan").collect() if r.key == k) for k in want} == want


# --- Entry


def test_the_rest_works_without_the_training_data_package(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("quillframe.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "quillframe.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert "section_split" in entry.queries() and not [n for n in entry.queries() if n.startswith("op") and n[2:3].isdigit()] and "pipeline" not in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_related_rows_are_paired_by_all_tasks(spark):
    """Rows that one task reads are dealt by key before they meet, so that no task sorts the pairs of all."""
    rows = spark.range(8).coalesce(1).select("id", F.array(F.lit("a")).alias("topics"), F.col("id").cast("string").alias("dated"))
    found = search.related(rows, "id", "topics", "dated", 2)
    assert "RepartitionByExpression" in found._jdf.queryExecution().analyzed().toString()
    assert sorted((r["id"], r["rank"], r["other"]) for r in found.collect() if r["id"] in (0, 7)) == [(0, 1, 7), (0, 2, 6), (7, 1, 6), (7, 2, 5)]
