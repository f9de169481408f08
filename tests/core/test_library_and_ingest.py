"""The life cycle of drafts and cases, whole imports, ingest that is tried again, related rows and extractors that fail."""

import pytest
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.operators import extract, html, library, search, validate
from quillframe.streaming import inbox

CATALOG = "case_id string, document_hash string, case_number string, document_type string, raw_number string, raw_type string"
UPLOAD = "draft_id string, target_id string, document_hash string, case_number string, document_type string, record string, created_at timestamp, filename string, content binary"
FIELDS = "draft_id string, case_number string, document_type string, edits string"


def test_drafts_become_cases(spark, tmp_path):
    shelf, nothing = library.Library(spark, f"file://{tmp_path}/shelf"), spark.createDataFrame([], CATALOG)
    up = lambda *rows: spark.createDataFrame([(d, t, h, n, "putusan", "{}", None, f"{h}.pdf", b"%PDF-") for d, t, h, n in rows], UPLOAD)
    assert shelf.stage(up(("d1", None, "h1", "1/PUU/2020"), ("d2", None, "h2", "2/PUU/2020"), ("d3", None, "h2", "3/PUU/2020")), nothing).isEmpty()
    assert shelf.files().count() == 2 and shelf.drafts().count() == 3
    assert [r.error for r in shelf.stage(up(("d9", "case-x", "h9", None)), nothing).collect()] == ["unknown target"] and shelf.files().count() == 2
    same = spark.createDataFrame([("d1", "1 / PUU / 2020", "putusan", "{}"), ("d2", "1/PUU/2020", "putusan", None)], FIELDS)
    with pytest.raises(library.ConflictError, match="duplicate"):
        shelf.publish(same)
    assert shelf.cases().isEmpty() and shelf.drafts().count() == 3
    shelf.publish(same.limit(1))
    case = shelf.cases().first()
    assert (case.case_number, case.revision, case.document_hash) == ("1/PUU/2020", 1, "h1") and {r.id for r in shelf.drafts().collect()} == {"d2", "d3"}
    with pytest.raises(library.ConflictError, match="no such draft"):
        shelf.publish(same.limit(1))
    edit = spark.createDataFrame([(case.id, 1, "1/PUU/2021", "putusan", "{e}")], "id string, revision long, case_number string, document_type string, edits string")
    shelf.edit(edit)
    with pytest.raises(library.ConflictError, match="stale"):
        shelf.edit(edit)
    assert (shelf.cases().first().edits, shelf.cases().first().record) == ("{e}", "{}")
    shelf.discard(spark.createDataFrame([("d2",)], "draft_id string"))
    assert {r.hash for r in shelf.files().collect()} == {"h1", "h2"}
    shelf.discard(spark.createDataFrame([("d3",)], "draft_id string"))
    assert {r.hash for r in shelf.files().collect()} == {"h1"} and shelf.drafts().isEmpty()
    shelf.stage(up(("d4", case.id, "h2", "x")), spark.createDataFrame([(case.id, "h1", "1/PUU/2021", "putusan", None, None)], CATALOG))
    draft = shelf.drafts().first()
    assert (draft.target, draft.base, draft.edits) == (case.id, 2, "{e}") and {r.hash for r in shelf.files().collect()} == {"h1", "h2"}


def test_an_import_is_whole_or_not_at_all(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    good, bad = spark.createDataFrame([("a",)], "file_name string"), spark.createDataFrame([("b", "checksum")], "file_name string, reason string")
    assert library.import_all(good, bad, path).count() == 1 and not (tmp_path / "out").exists()
    broken = good.withColumn("x", F.udf(lambda v: 1 / 0, "int")("file_name"))
    with pytest.raises(Exception, match="division"):
        library.import_all(broken, bad.limit(0), path)
    assert not (tmp_path / "out").exists()
    library.import_all(good, bad.limit(0), path)
    with pytest.raises(library.ConflictError):
        library.import_all(good, bad.limit(0), path)
    records = spark.createDataFrame([("a", ("1", None)), ("b", ("2", "x"))], "file_name string, document struct<case_number:string,title:string>")
    facts = spark.createDataFrame([("a", ("T",))], "file_name string, document struct<title:string>")
    assert {r.file_name: tuple(r.document) for r in library.with_facts(records, facts).collect()} == {"a": ("1", "T"), "b": ("2", "x")}
    known = spark.createDataFrame([("1", "p")], "case_number string, document_type string")
    manifest = known.union(spark.createDataFrame([("2", "p")], known.schema))
    assert tuple(library.import_counts(manifest, known).first()) == (0, 1, 1, 0) and tuple(library.import_counts(manifest, known, good, bad).first()) == (1, 1, 0, 1)


def test_a_batch_tried_again_is_recorded_once(spark, tmp_path):
    manifest, records = f"file://{tmp_path}/manifest", f"file://{tmp_path}/records"
    files = lambda *texts: spark.createDataFrame([(t, f"{t}.txt", t) for t in texts], "hash string, path string, text string")
    done = lambda f: f.withColumn("status", F.lit("processed"))

    def failing(f):
        raise RuntimeError("lost")

    inbox.record_batch(files("a", "b"), "s-0", manifest, records, done)
    inbox.record_batch(files("a", "b"), "s-0", manifest, records, done)
    with pytest.raises(RuntimeError):
        inbox.record_batch(files("b", "c"), "s-1", manifest, records, failing)
    inbox.record_batch(files("b", "c"), "s-1", manifest, records, done)
    assert sorted(r.hash for r in spark.read.parquet(records).collect()) == ["a", "b", "c"]
    (tmp_path / "manifest" / "batch=s-1" / "part-x.parquet").write_bytes(b"broken")
    assert {r.hash for r in inbox.read_manifest(spark, manifest).collect()} == {"a", "b", "c"}
    inbox.record_batch(files("c"), "s-2", manifest, records, done, force=True)
    assert spark.read.parquet(records).count() == 4


def test_related_rows_equal_brute_force(spark):
    data = [(i, ["all", f"t{i % 7}", f"u{i % 3}"], None if i % 11 == 0 else f"2020-{i % 9}") for i in range(120)]
    got = sorted(map(tuple, search.related(spark.createDataFrame(data, "k int, topics array<string>, dated string"), "k", "topics", "dated").collect()))
    want = []
    for k, topics, _ in data:
        others = sorted((o for o in data if o[0] != k and set(o[1]) & set(topics)), key=lambda o: ([-ord(c) for c in o[2] or ""] or [0], o[0]))[:3]
        want += [(k, n + 1, o[0], ", ".join(sorted(set(o[1]) & set(topics)))) for n, o in enumerate(others)]
    assert got == sorted(want)


def test_first_spellings_keep_their_order(spark):
    row = spark.createDataFrame([(["b", "A", None, "B", "a", "c", None],)], "x array<string>").select(T.ordered_distinct(F.col("x"), F.lower).alias("y")).first()
    assert row.y == ["b", "A", None, "c"]


def test_extractors_that_fail_fail_alone(spark):
    docs = spark.createDataFrame([("a", "PUTUSAN"), ("b", "x"), ("c", "\0 no heading")], "file_name string, text string")
    found = {**extract.EXTRACTORS, "size": extract.guarded(lambda text, sections, document: 1 // (len(text) - 1), "int")}
    out = {r.source.file_name: r for r in extract.parse_documents(docs, extractors=found, schema='{"type": "object", "required": ["size", "none"]}').collect()}
    assert out["b"].size is None and out["b"].parser.failed_extractors == ["size"] and out["b"].parser.warnings[0].startswith("size failed: ")
    assert out["a"].size == 0 and out["a"].parser.failed_extractors == [] and out["a"].validation.schema_errors == ["none: missing required property"]
    assert out["c"].outcome.summary.endswith("tidak terdeteksi secara eksplisit")
    again = validate.with_validation(spark.createDataFrame([out["a"]], extract.parse_documents(docs, extractors=found, schema="{}").schema))
    assert again.first().validation.schema_errors == ["none: missing required property"]


def test_links_are_told_empty_after_decoding(spark):
    page = '<a href="/a">&nbsp;</a><a href="/b">x&nbsp;&nbsp;y</a><a href="/b">X Y</a>'
    out = html.page_links(spark.createDataFrame([(1, "http://h/p", page)], "id int, url string, html string"), "id").collect()
    assert [(r.title, r.url) for r in out] == [("x y", "http://h/b")]
