"""The search index, incremental views, positions, schema checks on variants, composed translations and isolated extractors, against brute force."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillframe.operators import catalog, extract, numbering, search_index, validate, views
from quillframe.sources import folders


def test_the_index_finds_what_a_scan_finds(spark, tmp_path):
    draw, path = random.Random(3), f"file://{tmp_path}/index"
    rows = [(i, "".join(draw.choice("aab cé日") for _ in range(draw.randrange(0, 40))), draw.choice(["abab", "cc", "", None])) for i in range(150)]
    rows += [(900, None, None), (901, "aaaaaaaa", "b"), (902, "abcabcabd", None), (903, "a𝄞b", None)]
    df = spark.createDataFrame(rows, "k long, x string, y string")
    search_index.write_index(df, "k", ["x", "y"], path, buckets=8)
    for terms in (["a"], ["ab"], ["aba"], ["aab "], ["aaaaa"], ["abcabd"], ["abcabcabd"], ["b", "aa", "abab"], ["zz"], ["aaaaaaaaa"], ["é", "日a"], ["ab", "ab"], ["𝄞b"], ["a𝄞b"]):
        want = sorted(k for k, x, y in rows if all(t in (x or "") or t in (y or "") for t in terms))
        assert sorted(r.k for r in search_index.search_index(spark, path, "k", terms, buckets=8).collect()) == want, terms
    with pytest.raises(ValueError):
        search_index.search_index(spark, path, "k", [""])
    plan = search_index.search_index(spark, path, "k", ["abcabd"], buckets=8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2 and "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket), ", "") or "bucket#" in plan


def test_a_view_is_refreshed_where_it_changed(spark, tmp_path):
    path, computed = f"file://{tmp_path}/view", []

    def compute(rows):
        found = rows.select("k", F.upper("v").alias("u"))
        computed.append(sorted(r.k for r in found.collect()))
        return found.where("u <> 'NONE'")

    rows = lambda **kv: spark.createDataFrame([(k, v) for k, v in kv.items()], "k string, v string")
    read = lambda: {r.k: r.u for r in views.read_view(spark, path, "k string, u string").collect()}
    assert read() == {}
    many = {f"k{i}": f"v{i}" for i in range(40)}
    one = views.refresh(rows(**many), "k", F.col("v"), path, compute, buckets=8)
    assert (one.version, one.computed, one.gone) == (1, 40, 0) and read() == {k: v.upper() for k, v in many.items()}
    assert views.refresh(rows(**many), "k", F.col("v"), path, compute) == views.Refreshed(1, 0, 0, 0)
    del many["k7"]
    many |= {"k3": "new", "k4": "none", "x": "y"}
    two = views.refresh(rows(**many), "k", F.col("v"), path, compute)
    assert (two.computed, two.gone) == (3, 1) and two.buckets <= 4 and computed[-1] == ["k3", "k4", "x"]
    want = {k: v.upper() for k, v in many.items() if v != "none"}
    assert read() == want and len(folders.names_in(spark, f"{path}/rows")) == 2
    # One that is overtaken, and one that breaks off, change nothing.
    put = views.put_new
    views.put_new = lambda *a: False
    try:
        with pytest.raises(FileExistsError):
            views.refresh(rows(**(many | {"x": "late"})), "k", F.col("v"), path, compute)
    finally:
        views.put_new = put
    assert read() == want
    assert views.sweep(spark, path) == 2 and read() == want
    assert views.refresh(rows(only="z"), "k", F.col("v"), path, compute).gone == len(many) and read() == {"only": "Z"}


def test_files_that_changed_are_told_by_their_metadata(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    files = lambda: spark.read.text(f"file://{tmp_path}/*.txt", wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value", views.file_signature().alias("sig"))
    done = lambda rows: rows.select("name", "value")
    path = f"file://{tmp_path}/view"
    assert views.refresh(files(), "name", F.col("sig"), path, done).computed == 1
    (tmp_path / "b.txt").write_text("two")
    assert views.refresh(files(), "name", F.col("sig"), path, done).computed == 1
    (tmp_path / "a.txt").write_text("longer")
    assert views.refresh(files(), "name", F.col("sig"), path, done).computed == 1
    assert {r.name: r.value for r in views.read_view(spark, path, "name string, value string").collect()} == {"a.txt": "longer", "b.txt": "two"}


@pytest.mark.parametrize("partitions", [1, 5])
def test_positions_are_gapless(spark, partitions):
    rows = [(i, None if i % 5 == 0 else i * 37 % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(7)
    got = {r.position: r.k for r in numbering.ordered(df, [F.col("v").desc_nulls_last(), F.col("k")], partitions=partitions).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [got[i] for i in range(500)] == [k for k, _ in want] and len(got) == 500
    assert numbering.ordered(df.limit(0), [F.col("k")]).count() == 0


SCHEMA = {
    "type": "object",
    "required": ["a", "b"],
    "properties": {"a": {"type": "string", "enum": ["x", "it's", 'q"', None]}, "b": {"type": ["integer", "null"]}, "c": {"type": "array", "items": {"$ref": "#/d/p"}}, "e": {"enum": [1, True, "1", None, 2.5]}, "f": {"type": "number"}, "g": {"type": "boolean"}},
    "d": {"p": {"type": "object", "required": ["n"], "properties": {"n": {"type": "string"}, "m": {"type": "array", "items": {"type": "integer"}}}}},
}


def test_variants_give_the_messages_of_plain_python(spark):
    draw = random.Random(1)
    scalars = [None, True, False, 0, 7, -3, 2.5, 1.5e300, 12345678901234567890, "x", "it's", 'q"', "1", "", "a\\b\n", "é"]

    def value(depth):
        kind = draw.randrange(6)
        if kind == 0 and depth:
            return [value(depth - 1) for _ in range(draw.randrange(4))]
        if kind == 1 and depth:
            return {k: value(depth - 1) for k in draw.sample("nmxab", draw.randrange(4))}
        return draw.choice(scalars)

    documents = [value(2) for _ in range(40)] + [{k: value(3) for k in draw.sample("abcefgh", draw.randrange(8))} for _ in range(300)]
    raw = [json.dumps(d, ensure_ascii=False) for d in documents] + ["", "{", "nope"]
    df = spark.createDataFrame(list(enumerate(raw)), "k int, raw string")
    rules = validate.compile_schema(SCHEMA)
    got = {r.k: r.e for r in df.select("k", validate.schema_errors(F.col("raw"), json.dumps(SCHEMA)).alias("e")).collect()}
    for k, d in enumerate(documents):
        want = list(validate.schema_messages(d, rules))
        if not any("{" in m or "[" in m.split("one of")[0] or "e+300" in m for m in want):  # a whole object is not shown
            assert got[k] == want, raw[k]
    assert all(got[len(documents) + i] == ["<root>: not JSON"] for i in range(3))
    assert "ArrowEvalPython" not in df.select(validate.schema_errors(F.col("raw"), json.dumps(SCHEMA)))._jdf.queryExecution().executedPlan().toString()


def test_draft_messages_and_schemas_that_refer_to_themselves(spark):
    df = spark.createDataFrame([('{"a": 5, "c": [{"n": 1}, {}]}',), ('{"a": "x", "b": null}',)], "raw string")
    got = [r.e for r in df.select(validate.schema_errors(F.col("raw"), json.dumps(SCHEMA), "draft").alias("e")).collect()]
    assert got == [["<root>: 'b' is a required property", "a: 5 is not of type 'string'", """a: 5 is not one of ['x', "it's", 'q"', None]""", "c/0/n: 1 is not of type 'string'", "c/1: 'n' is a required property"], []]
    tree = json.dumps({"$ref": "#/d/t", "d": {"t": {"type": "object", "properties": {"l": {"$ref": "#/d/t"}}}}})
    df = spark.createDataFrame([('{"l": {"l": {"l": 1}}}',)], "raw string")
    assert df.select(validate.schema_errors(F.col("raw"), tree).alias("e")).first().e == ["l/l/l: expected object"]
    with pytest.raises(ValueError):
        validate.variant_errors(F.col("raw"), tree)


def test_records_are_checked_without_text(spark):
    df = spark.createDataFrame([("x", 3, [("p", [1])]), (None, None, [(None, None)])], "a string, b int, c array<struct<n:string,m:array<int>>>")
    got = [r.e for r in df.select(validate.record_errors(F.struct("a", "b", "c"), json.dumps(SCHEMA)).alias("e")).collect()]
    assert got == [[], ["a: expected string", "c/0/n: expected string", "c/0/m: expected array"]]


def test_composed_texts_are_translated_part_by_part(spark):
    dictionary = spark.createDataFrame([("Pendidikan", "Education"), ("Hutan adat", "Customary forest"), ("Topik", "Topic"), ("halaman", "page")], "source string, target string")
    want = {
        "Pendidikan": "Education", " Pendidikan\n": " Education\n", "Halaman 3": "Page 3", "Sama-sama membahas Pendidikan, Hutan adat, lain": "Also about Education, Customary forest, lain",
        "Disusun dari: Hutan adat · teks asli.": "Prepared from: Customary forest · Indonesian match.", "Topik: Pendidikan": "Topic: Education", "Tak ada: Pendidikan": "Tak ada: Pendidikan", "Hapus Topik: Hutan adat": "Remove Topic: Customary forest",
        "Hapus Pendidikan": "Remove Education", "· 12 perkara ↗": "· 12 cases ↗", "Topik: Topik: · Pendidikan →": "Topic: Topic: · Education →", "31 Desember 2020 dan 1 Mei 2019 · Ketetapan": "31 December 2020 and".replace("and", "dan") + " 1 May 2019 · Order",
        "perkara · 4 topik": "cases · 4 topics", "x (+2 item lain disembunyikan)": "x (+2 more items hidden)", "Satu pertanyaan · 3 putusan · 3 bab": "One question · 3 decisions · 3 chapters", "": "", "  ": "  ", "perkara lain": "perkara lain", "Pendidikan · ABCD": "Education · ABCD",
    }
    df = spark.createDataFrame([(t,) for t in [*want, *want]] + [(None,)], "t string")
    got = catalog.translate_composite(df, "t", dictionary, "e").collect()
    assert len(got) == 2 * len(want) + 1 and {r.t: r.e for r in got} == want | {None: None}
    assert catalog.translate_composite(df.limit(0), "t", dictionary, "e").count() == 0
    with pytest.raises(ValueError, match="nested"):
        catalog.translate_composite(spark.createDataFrame([("Topik: " * 5 + "x",)], "t string"), "t", dictionary, "e", most=3).collect()


def test_an_extractor_that_raises_for_a_row_fails_for_that_row_only(spark):
    docs = spark.createDataFrame([(f"f{i}", f"PUTUSAN\nNomor {i}/PUU-XIX/2021\n{'kaput' if i == 2 else 'x'}") for i in range(4)], "file_name string, text string")
    raising = {**extract.EXTRACTORS, "proceedings": lambda t, s, d: F.when(t.contains("kaput"), F.raise_error(F.lit("it is kaput")).cast("array<string>")).otherwise(extract.EXTRACTORS["proceedings"](t, s, d))}
    with pytest.raises(Exception, match="kaput"):
        extract.parse_documents(docs, extractors=raising).collect()
    got = {r.source.file_name: r for r in extract.parse_isolated(docs, extractors=raising, fan=2).collect()}
    plain = {r.source.file_name: r for r in extract.parse_documents(docs).collect()}
    assert len(got) == 4
    for name, r in got.items():
        if name == "f2":
            assert r.proceedings is None and r.parser.failed_extractors == ["proceedings"] and r.parser.warnings[0].startswith("proceedings failed: ") and "kaput" in r.parser.warnings[0]
            assert r.parser.status == "partial" and r.document == plain[name].document and r.parties == plain[name].parties
        else:
            assert r == plain[name]


def test_rows_that_raise_are_found_among_many(spark):
    compute = lambda part: part.select(F.when(F.col("id").isin(7, 8, 250), F.raise_error(F.concat(F.lit("bad "), F.col("id").cast("string")))).otherwise("fine").alias("x"))
    assert sorted((k, e.rpartition("bad ")[2].split()[0]) for k, e in extract.raising_rows(spark.range(300), "id", compute)) == [(7, "7"), (8, "8"), (250, "250")]
    with pytest.raises(RuntimeError, match="more than 2"):
        extract.raising_rows(spark.range(300), "id", compute, most=2)
    assert extract.raising_rows(spark.range(300), "id", lambda part: part) == []


def test_postings_hold_few_texts_at_once(spark, monkeypatch):
    """Grams are made chunk by chunk, however many rows a batch has, and each is there once with all of its places."""
    texts = [None, "", "a", "ab", "aaaa", "née\U0001f600\U0001f600 née", "abcabcabc" * 3]
    keys = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([keys, pa.array(texts)], ["key", "text"])
    monkeypatch.setattr(search_index, "CHUNK_CHARS", 4)
    got = [r for b in search_index._grams(5)([batch]) for r in b.to_pylist()]
    assert max(len({r["key"] for r in b.to_pylist()}) for b in search_index._grams(5)([batch])) <= 3
    expected = [(i, t[p : p + k]) for i, t in enumerate(texts) for k in (1, 2, 3) for p in range(len(t or "") - k + 1)]
    assert sorted((r["key"], r["gram"]) for r in got) == sorted(set(expected)) and {r["field"] for r in got} == {5}
    assert all(r["positions"] == (None if len(r["gram"]) < 3 else [p for p in range(len(texts[r["key"]])) if texts[r["key"]].startswith(r["gram"], p)]) for r in got)
    assert {tuple(r) for r in search_index.postings(spark.createDataFrame([(7, "abc")], "id long, t string"), "id", ["t"]).where("positions is not null").select("id", "gram", "field").collect()} == {(7, "abc", 0)}
