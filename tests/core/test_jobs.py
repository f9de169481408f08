from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.operators import catalog, sections
from quillframe.plans import jobs

GOOD = "PUTUSAN\nNomor 31/PUU-XIX/2021\nNama : Rina\nPekerjaan : Guru\nDUDUK PERKARA\nPasal 1 UUD 1945\nAMAR PUTUSAN\n1. Menolak\nDemikian diputus, diucapkan 4 Mei 2022\nKETUA,\nHakim A\n"


def test_a_whole_run(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text(GOOD)
    (tmp_path / "in" / "deep" / "b.txt").write_text("KETETAPAN\n")
    out = f"file://{tmp_path}/out"
    got = {(r.stage, r.kind, r.value): r.n for r in jobs.run(spark, f"file://{tmp_path}/in", out).collect()}
    assert got[("parsed", "file_count", "")] == 2 and got[("validated", "file_count", "")] == 1 and got[("review_queue", "status", "partial")] == 1
    templates = spark.read.json(f"{out}/manual_truth").collect()
    assert [t.source_file for t in templates] == ["b.txt"]
    routed = spark.read.parquet(f"{out}/routed")
    again = jobs.check(spark, routed.drop("route"), f"{out}/again")
    assert sorted((r.case_id, r.route) for r in again.collect()) == [("a", "validated"), ("b", "review_queue")]


def test_ingest(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    (box / "a.txt").write_text(GOOD)
    (box / "copy.txt").write_text(GOOD)
    (box / "b.txt").write_text("KETETAPAN\n")
    for _ in range(2):
        jobs.ingest(spark, f"file://{box}", f"file://{tmp_path}/out")
    assert sorted(r.status for r in spark.read.parquet(f"file://{tmp_path}/out/manifest").collect()) == ["processed", "review"]
    assert spark.read.parquet(f"file://{tmp_path}/out/records").count() == 2


def test_small_parts(spark):
    pairs = [("https://x.example/a?b=1", "http://X.example/a/?b=1", True), ("https://x.example/a?b=1", "https://y.example/a?b=1", True), ("https://x.example/a?id=3&p=download.putusan", "https://y.example/b?p=download.putusan&id=3", True), ("https://x.example/a?id=3", "https://x.example/b?id=3", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", T.urls_equivalent(F.col("a"), F.col("b"))).collect())
    words = spark.createDataFrame([("Bagian 2 dari 5",), ("12 perkara",), ("12 perkara lama",)], "t string")
    assert [r.e for r in words.select(catalog.translate_phrases(F.col("t")).alias("e")).collect()] == ["Part 2 of 5", "12 cases", "12 perkara lama"]
    text = "x\nDUDUK PERKARA\n" + "y" * 300 + "\n1. sebuah judul yang panjang sekali dan tidak memberi tahu apa pun kepada pembaca\nz"
    shown = spark.range(1).select(sections.preview(sections.split_sections(F.lit(text))).alias("p")).first()["p"]
    assert [(s["heading"], len(s["excerpt"])) for s in shown] == [("pembuka", 1), ("DUDUK PERKARA", 283)]
