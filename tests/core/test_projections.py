"""Small projections: case types and addresses, insights, cards, one case, one file."""

from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.operators import catalog, stories
from quillframe.sources import readers


def test_case_types_and_addresses(spark):
    rows = [(" PUU ", "1/PHPU/2020", "PUU", "1%2FPHPU%2F2020&jenis=PUU"), (None, "133/PUU-XXIII/2025", "PUU", "133%2FPUU-XXIII%2F2025&jenis=PUU"), ("", "no type~*", None, "no+type~%2A"), ("x", None, "x", None), (None, " ", None, None)]
    got = spark.createDataFrame(rows, "t string, n string, type string, url string").select("type", "url", T.case_type_of(F.col("t"), F.col("n")).alias("got_type"), T.search_url("https://h/p", F.col("t"), F.col("n")).alias("got_url")).collect()
    assert all(r.got_type == r.type and r.got_url == (r.url and f"https://h/p?search={r.url}") for r in got)


def test_insights_as_rows(spark):
    schema = "case_number string, change struct<before:string,after:string,page:int,pages:array<int>>, reasoning array<struct<title:string,page:int>>, thresholds struct<page:int,rows:array<array<string>>>, court struct<page:int,positions:array<struct<name:string,page:int>>>"
    rows = [("1", ("b", "a", 4, None), [("t", 7), ("u", None)], (9, [["10%", "x"], ["8%", "y"]]), (3, [("J", 0), ("K", 12)])), ("2", None, None, None, None), ("3", ("b", "a", 4, [5, 6]), [], None, (None, None))]
    df = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, stories.insight_changes(df).collect())) == [("1", "b", "a", [4]), ("3", "b", "a", [5, 6])]
    assert [tuple(r) for r in stories.insight_thresholds(df).orderBy("pos").collect()] == [("1", 9, 0, ["10%", "x"]), ("1", 9, 1, ["8%", "y"])]
    got = sorted((r.case_number, r.part, r.pos, r.page, r.label) for r in stories.citations(df).collect())
    assert got == [("1", "change", 0, 4, "PDF hlm. 4"), ("1", "court", 0, 3, "PDF hlm. 3"), ("1", "positions", 1, 12, "PDF hlm. 12"), ("1", "reasoning", 0, 7, "PDF hlm. 7"), ("1", "thresholds", 0, 9, "PDF hlm. 9"), ("3", "change", 0, 5, "PDF hlm. 5"), ("3", "change", 1, 6, "PDF hlm. 6")]


def test_cards_and_one_case(spark):
    entries = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y")], "slug string, chapter string")
    cards = stories.story_cards(spark.createDataFrame([("a",), ("b",)], "slug string"), entries).collect()
    assert {r.slug: (r.n_entries, r.n_chapters) for r in cards} == {"a": (3, 2), "b": (0, 0)}
    records = spark.createDataFrame([("c", "parsed_json", 1), ("c", "review_queue", 2), ("d", "parsed_json", 3)], "case_id string, source_name string, n int")
    assert [(r.source_name, r.n) for r in catalog.case_record(records, "c", payload=["n"]).collect()] == [("review_queue", 2)]
    assert catalog.case_record(records, "none").isEmpty()


def test_one_file_or_a_folder(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt"):
        (tmp_path / name).write_bytes(b"%PDF-")
    names = lambda path: sorted(r.file_name for r in readers.read_files(spark, f"file://{path}").select("file_name").collect())
    assert names(tmp_path) == ["a.pdf"] and names(tmp_path / "b.PDF") == ["b.PDF"] and names(tmp_path / "c.txt") == []
    assert readers.input_label("x") == "x" and readers.input_label(["x"]) == "<explicit-list>"
