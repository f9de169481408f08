import json

import pytest
from pyspark.sql import functions as F

from quillframe.functions import search_text as S
from quillframe.functions import text as T
from quillframe.operators import extract, sections, validate
from quillframe.plans import queries


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def of(spark, f, value):
    return one(spark, f(F.col("v")), v=value)


@pytest.mark.parametrize("text,want", [("  a \t\n b ", "a b"), ("", ""), ("a  b", "a b"), ("\x1ca\x1f", "a")])
def test_whitespace(spark, text, want):
    assert of(spark, T.normalize_whitespace, text) == want == " ".join(text.split())


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x85e f", "a\n b \n"])
def test_lines_are_those_of_python(spark, text):
    assert of(spark, T.lines, text) == text.splitlines()


def test_case_numbers(spark):
    text = "Nomor 12 / PUU - XX / 2022\n dan 5/ PUU-I/2003, 12/PUU-XX/2022"
    assert of(spark, T.normalize_case_number, "x 7/PUU-XXI/2023 y") == "7/PUU-XXI/2023"
    assert of(spark, T.normalize_case_number, "none") is None
    assert of(spark, T.extract_case_numbers, text) == ["5/PUU-I/2003", "12/PUU-XX/2022"]


@pytest.mark.parametrize("text,want", [("17", 17), ("dua puluh satu", 21), ("dua belas", 12), ("dua ribu dua puluh lima", 2025), ("seribu", 0), ("tiga ratus empat", 304), ("99999999999999", None)])
def test_numbers(spark, text, want):
    assert of(spark, T.number_of, text) == want


@pytest.mark.parametrize(
    "text,want",
    [("pada tanggal 3 Maret 2021", "2021-03-03"), ("tujuh, bulan Mei, tahun dua ribu dua puluh empat", "2024-05-07"), ("31 Februari 2020", None), ("1 Juni 1899", None), ("kemarin", None), ("29 Februari 2024", "2024-02-29")],
)
def test_dates(spark, text, want):
    assert of(spark, T.normalize_date, text) == want


@pytest.mark.parametrize(
    "text,want",
    [("1. 2) Pemohon: Budi Santoso, S.H.;", "Budi Santoso, S.H"), ("Ahli - Siti yang dalam hal ini bertindak", "Siti"), ("PT Maju selaku pemilik", "PT Maju"), ("  ", "")],
)
def test_party_names(spark, text, want):
    assert of(spark, T.normalize_party_name, text) == want


def test_small_functions(spark):
    assert of(spark, T.slugify, "  Duduk -- Perkara! ") == "duduk-perkara" and of(spark, T.slugify, "…") == "section"
    assert of(spark, T.normalize_article, "lihat Pasal 28D ayat (1) huruf") == "Pasal 28D ayat (1) huruf" or of(spark, T.normalize_article, "lihat Pasal 28D ayat (1)") == "Pasal 28D ayat (1)"
    assert of(spark, T.slugify_case_number, "7/PUU XX/2020") == "7_PUUXX_2020"
    assert of(spark, T.url_component, "a b/ç~*") == "a%20b%2F%C3%A7~%2A"
    assert of(spark, T.file_name_of_url, "https://x.example/a/b.pdf?q=1") == "b.pdf" and of(spark, T.file_name_of_url, "https://x.example/") is None
    assert of(spark, T.url_key, "https://X.example/a/?b=2&a=1") == of(spark, T.url_key, "http://x.example/a?a=1&b=2")
    assert of(spark, T.display_date, "2021-03-05") == "5 Maret 2021" and of(spark, T.display_date, "lama") == "lama"
    assert of(spark, lambda c: T.label_of(c, {"ok": "Baik"}), "ok") == "Baik" and of(spark, lambda c: T.label_of(c, {"ok": "Baik"}), "z") == "z"
    assert of(spark, lambda c: T.in_app_return(c, "/cases"), "/cases?x=1#y") == "/cases?x=1#results" and of(spark, lambda c: T.in_app_return(c, "/cases"), "//evil") == "/cases#results"
    assert of(spark, T.to_roman, 1994) == "MCMXCIV"
    with pytest.raises(Exception, match="Roman"):
        of(spark, T.to_roman, 0)


@pytest.mark.parametrize(
    "text,want",
    [("Mengabulkan untuk sebagian", "granted_partly"), ("Mengabulkan", "granted"), ("Menolak", "rejected"), ("Menolak; tidak dapat diterima", "mixed"), ("tidak dapat diterima", "inadmissible"), ("Mengabulkan penarikan kembali", "withdrawn"), ("permohonan gugur", "dismissed"), (None, "unknown"), ("mengabulkan; tidak dapat diterima; menolak", "inadmissible")],
)
def test_outcomes(spark, text, want):
    assert one(spark, T.classify_outcome(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    "title,url,want",
    [("Putusan", "x", "decision"), ("PDF", "/download.putusan?id=1", "decision"), ("Perbaikan Permohonan", "x", "petition_revision"), ("Permohonan", "x", "petition"), ("PDF", "/risalah/1", "hearing_minutes_pdf"), ("Audio", "x", "hearing_audio"), ("Jadwal Sidang", "x", "hearing_schedule"), ("AP3", "x", "ap3"), ("?", "x", "other"), (None, None, "other")],
)
def test_document_categories(spark, title, url, want):
    assert one(spark, T.document_category(F.lit(title).cast("string"), F.lit(url).cast("string"))) == want


# --- Sections


def spans(spark, text, **how):
    return [(s["heading"], s["slug"], s["text"], s["start_line"], s["end_line"]) for s in of(spark, lambda c: sections.split_sections(c, **how), text)]


def test_sections(spark):
    text = "PUTUSAN\nawal\n\nDUDUK PERKARA\nsatu\ndua\nMENIMBANG\nMENGADILI\n1. item\nisi"
    assert spans(spark, text) == [("pembuka", "pembuka", "PUTUSAN\nawal", 1, 3), ("DUDUK PERKARA", "duduk-perkara", "satu\ndua", 5, 6), ("1. item", "1-item", "isi", 10, 10)]
    assert spans(spark, "") == [("pembuka", "pembuka", "", 1, 1)]
    assert spans(spark, "MENIMBANG\nMENGADILI") == [("MENGADILI", "mengadili", "", 3, 2)]
    assert spans(spark, "a\n\n") == [("pembuka", "pembuka", "a", 1, 2)]


def test_sections_of_a_table(spark):
    df = spark.createDataFrame([(1, "x\nBUKTI\ny"), (2, None)], "id long, text string")
    rows = sections.explode_sections(df, "id").orderBy("id", "idx").collect()
    assert [(r.id, r.idx, r.heading, r.text) for r in rows] == [(1, 1, "pembuka", "x"), (1, 2, "BUKTI", "y"), (2, 1, "pembuka", "")]
    assert [(r.id, r.line_no, r.line) for r in sections.number_lines(df, "id").orderBy("line_no").collect()] == [(1, 1, "x"), (1, 2, "BUKTI"), (1, 3, "y")]


# --- Extraction: texts of our own


RULING = """PUTUSAN
Nomor 31/PUU-XIX/2021
Pengujian Undang-Undang Nomor 7 Tahun 2017 terhadap Undang-Undang Dasar Negara
1. Nama : Rina Wulandari, S.H.
Pekerjaan : Guru
2. Nama : Joko Prasetyo
Alamat : Solo
memberikan kuasa kepada Tono Hadi, S.H., M.H. dan Lina Sari; selanjutnya disebut Pemohon
DUDUK PERKARA
Menimbang Pasal 28D ayat (1) UUD 1945 dan putusan 5/PUU-X/2012
Bukti P-1 dan bukti P-2
mendengar keterangan ahli
Nama : Dr. Ahli Satu
Pekerjaan : Dosen
Presiden dan DPR memberi keterangan
Sidang Pleno terbuka
AMAR PUTUSAN
Mengadili:
Dalam Pokok Permohonan
1. Mengabulkan permohonan untuk sebagian ;
2. Menolak selebihnya
12
Demikian diputus dalam rapat pada 2 Januari 2021, diucapkan pada hari Rabu,
tanggal empat, bulan Februari, tahun dua ribu dua puluh dua
KETUA,
ttd. Hakim Satu
Hakim Dua
PANITERA PENGGANTI,
ttd. Panitera Tiga
Juru Tulis
"""


@pytest.fixture(scope="module")
def record(spark):
    df = spark.createDataFrame([("a.txt", RULING), ("b.txt", None)], "file_name string, text string")
    return {r["source"]["file_name"]: r.asDict(True) for r in extract.parse_documents(df).collect()}


def test_facts_of_a_ruling(record):
    r = record["a.txt"]
    assert {k: r["document"][k] for k in ("document_type", "case_type", "case_number", "decision_date", "title")} == {"document_type": "putusan", "case_type": "PUU", "case_number": "31/PUU-XIX/2021", "decision_date": "2022-02-04", "title": "PUTUSAN"}
    assert "5/PUU-X/2012" in r["document"]["related_case_numbers"]
    names = {k: [p["name"] for p in v] for k, v in r["parties"].items()}
    assert names["applicants"] == ["Rina Wulandari, S.H", "Joko Prasetyo"]
    assert names["legal_counsels"] == ["Tono Hadi, S.H., M.H", "Lina Sari"]
    assert names["respondents"] == ["DPR", "Presiden"] and names["experts"] == ["Dr. Ahli Satu"] and names["witnesses"] == []
    assert r["outcome"] == {"decision_type": "putusan", "dictum": ["Mengabulkan permohonan untuk sebagian;", "Menolak selebihnya"], "summary": "Mengabulkan permohonan untuk sebagian;"}
    assert r["adjudicators"] == {"judges": ["Hakim Satu", "Hakim Dua"], "clerks": ["Juru Tulis"]}
    assert r["legal_basis"]["object_of_review"] == ["Undang-Undang Nomor 7 Tahun 2017"]
    assert r["legal_basis"]["constitutional_articles"] == ["Pasal 28D ayat (1)"]
    assert r["legal_basis"]["evidence"][:2] == ["BUKTI P-1", "BUKTI P-2"]
    assert r["proceedings"][:2] == ["mendengar keterangan ahli", "sidang pleno"]
    assert r["relations"]["joined_cases"] == r["relations"]["referenced_cases"] and "31/PUU-XIX/2021" in r["relations"]["joined_cases"]
    assert r["parser"] == {"status": "ok", "warnings": [], "failed_extractors": []} and not r["validation"]["needs_manual_review"]


def test_an_empty_document(record):
    r = record["b.txt"]
    assert r["parser"]["status"] == "partial" and r["outcome"]["summary"] == "amar putusan tidak terdeteksi secara eksplisit"
    assert r["validation"]["business_rule_errors"] == ["document.case_number is required by business rules", "document.document_type could not be inferred", "at least one party or participant should be detected"]
    assert r["validation"]["review_flags"] == ["too_few_sections_detected", "decision_date_missing", "judges_not_extracted", "applicants_missing", "outcome_summary_not_in_amar_style"]
    assert r["parser"]["warnings"][-1] == "review:outcome_summary_not_in_amar_style"


def test_applicants_in_a_sentence(spark):
    text = "KETETAPAN\npermohonan bertanggal 1 Mei 2020 dari Andi, S.H. dan Bela, yang memberi\n"
    df = spark.createDataFrame([("x", text), ("y", "Pemohon: Citra Dewi;\n"), ("z", "surat atas nama Dodi (alias D)")], "file_name string, text string")
    found = {r["source"]["file_name"]: [p["name"] for p in r["parties"]["applicants"]] for r in extract.parse_documents(df).collect()}
    assert found == {"x": ["Andi, S.H", "Bela"], "y": ["Citra Dewi"], "z": ["Dodi"]}


def test_manual_truth(spark):
    df = extract.parse_documents(spark.createDataFrame([("a.txt", RULING)], "file_name string, text string"))
    r = extract.manual_truth_template(df).first()
    assert r.source_file == "a.txt" and r.status == "needs_annotation" and r.verified_fields["applicants"] == ["Rina Wulandari, S.H", "Joko Prasetyo"] and not r.accept_parser_output


# --- Checks


def test_group_flags_stop_at_the_first_bad_name(spark):
    people = "array<struct<name:string>>"
    cases = [([""], ["g_contains_empty_name"]), (["ok", "x" * 121, ""], ["g_contains_very_long_name"]), (["", "Alamat rumah", "x" * 200], ["g_contains_empty_name", "g_contains_suspicious_text"]), (["a"], []), ([], [])]
    for names, want in cases:
        df = spark.createDataFrame([([(n,) for n in names],)], f"p {people}")
        assert df.select(validate.group_flags(F.col("p"), "g").alias("f")).first()["f"] == want


SCHEMA = json.dumps({"$defs": {"s": {"type": ["string", "null"]}}, "type": "object", "required": ["a", "b"], "properties": {"a": {"$ref": "#/$defs/s"}, "b": {"type": "integer"}, "c": {"enum": ["x", None]}, "d": {"type": "array", "items": {"type": "object", "required": ["k"]}}}})


def test_schema_errors_tell_missing_from_null(spark):
    raw = ['{"a": null, "b": 1}', '{"b": true}', '{"a": 1, "b": 2, "c": "y", "d": [{}, 3]}', "not json", "[]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, raw string")
    got = {r.i: r.e for r in df.select("i", validate.schema_errors(F.col("raw"), SCHEMA).alias("e")).collect()}
    assert got == {0: [], 1: ["a: missing required property", "b: expected integer"], 2: ["a: expected one of ['string', 'null']", "c: value 'y' not in enum", "d/0/k: missing required property", "d/1: expected object"], 3: ["<root>: not JSON"], 4: ["<root>: expected object"]}


def test_compact(spark):
    items = F.array(*map(F.lit, ["Bukti P-1", "bukti  p-1", "Saksi", "Bukti " + "x" * 40, "Bukti P-2"]))
    shown = one(spark, validate.shown_as("evidence", items))
    assert shown["shown"] == ["Bukti P-1", "Bukti P-2"] and shown["hidden"] == 2
    names = one(spark, validate.shown_as("names", F.array(*map(F.lit, ["Budi", "Hakim 2", "Rapat Pleno"])), ["rapat"]))
    assert names["shown"] == ["Budi"] and names["hidden"] == 2
    assert one(spark, validate.shown_as("case_references", F.array(F.lit("7/PUU-I/2003"), F.lit("7/PUU/x"))))["shown"] == ["7/PUU-I/2003"]
    assert one(spark, validate.display_list(F.array(*map(F.lit, "abc")), 2)) == "a; b (+1)"


# --- Search text


@pytest.mark.parametrize(
    "text,has,lacks",
    [("UU ITE", ["informasi dan transaksi elektronik ite"], ["uu "]), ("Undang-Undang", ["uu"], ["undang"]), ("KUHP", ["kitab uu hukum pidana kuhp"], ["kuhap"]), ("Komisi Pemberantasan Korupsi", ["kpk"], []), ("batu bara", ["batubara"], ["batu bara"]), ("ＡＢＣ straße", ["abc strasse"], [])],
)
def test_folding(text, has, lacks):
    folded = S.fold(text)
    assert all(h in folded for h in has) and not any(x in folded for x in lacks)


def test_queries():
    q = S.read_query("putusan no. 007/PUU-XXI/2023 kebebasan")
    assert q.reference == {"number": "7", "kind": "puu", "roman": "xxi", "year": "2023"} and q.terms == ("kebebasan",)
    assert S.read_query("91 2020").reference == {"number": "91", "year": "2020"}
    assert S.read_query("UU Nomor 7/2017").reference is None
    assert S.read_query("").terms == ()


def test_matching_and_highlighting(spark):
    match = lambda n, **r: of(spark, lambda c: S.matches_reference(c, r), n)
    assert match("007/PUU-XXI/2023", number="7", year="2023") and not match("17/PUU-XXI/2023", number="7") and not match("x", number="7")
    assert of(spark, lambda c: S.highlight(c, "ite a"), "<ITE> kita") == "&lt;<mark>ITE</mark>&gt; k<mark>ita</mark>".replace("k<mark>ita</mark>", "kit<mark>a</mark>")


@pytest.mark.parametrize("name", ["ruling_facts", "decree_facts", "parse_rulings"])
def test_records_are_extracted_by_all_tasks(spark, name):
    """A file that one task reads isn't parsed by that task alone."""
    assert "RepartitionByExpression" in getattr(queries, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()


def test_lines_and_blanks_of_all_kinds(spark):
    texts = ["", " ", "a\nb\n", "\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i\u2028j\u2029k\n\n", " a  b \t c\xa0d \xa0e\u3000", "\x1fa \x1f b", "a b", "x\n y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(T.lines(F.col("t")).alias("lines"), T.normalize_whitespace(F.col("t")).alias("plain")).collect()
    assert [(r.lines, r.plain) for r in got] == [(t.splitlines(), " ".join(t.split())) for t in texts]
