"""Sync from run to run, snapshots, archive moves, forced ingest and commits of several writers: whole, tried again, and broken off."""

import threading

import pytest
from pyspark.sql import functions as F

from quillframe.operators import library
from quillframe.plans import jobs
from quillframe.sources import folders, moves, snapshots
from quillframe.streaming import inbox, sync

from .test_jobs import GOOD
from .test_library_and_ingest import CATALOG, FIELDS, UPLOAD

RESPONSES = "key string, sequence long, outcome string, body string"


def brute_sync(rows, runs, candidates, misses):
    """(key -> (last, next, misses)), and all (run, key, sequence) that were looked at."""
    state, looked = {}, []
    for run in range(1, runs + 1):
        for key in {r[0] for r in rows}:
            seen = count = 0
            for _, sequence, outcome, _ in sorted(r for r in rows if r[0] == key and r[1] >= state.get(key, (0, 0, 0))[1]):
                count = count + 1 if outcome == "miss" else 0 if outcome == "hit" else count
                seen += 1
                looked.append((run, key, sequence))
                state[key] = (sequence, sequence + 1, count)
                if outcome == "stop" or count >= misses or seen >= candidates:
                    break
    return state, looked


def test_sync_equals_brute_force_and_goes_on_after_a_failure(spark, tmp_path):
    kinds = ["hit", "miss", "miss", "hit", "stop", "miss", "hit"]
    rows = [(k, i, kinds[(i * 7 + len(k)) % 7], f"{k}{i}") for k in ("a", "bb", "ccc") for i in range(1, 60)] + [("only", 5, "miss", None)]
    place, out = f"file://{tmp_path}/responses", f"file://{tmp_path}/out"
    spark.createDataFrame(rows, RESPONSES).repartition(3).write.parquet(place)
    responses = lambda: spark.readStream.schema(RESPONSES).parquet(place)
    hits, broken = [], [True]

    def take(found, name):
        if broken:
            broken.clear()
            raise RuntimeError("lost")
        hits.append((name, sorted((r.key, r.sequence, r.body) for r in found.collect())))

    with pytest.raises(Exception, match="lost"):
        sync.sync(responses(), out, "key", take, 9, 3)
    assert sync.read_state(spark, out, "key", "string").isEmpty()
    for run in (1, 2, 3):
        assert sync.sync(responses(), out, "key", take, 9, 3) == run
    state, looked = brute_sync(rows, 3, 9, 3)
    assert {r.key: (r.last_checked, r.next, r.consecutive_misses) for r in sync.read_state(spark, out, "key", "string").collect()} == state
    assert sorted((r.run, r.key, r.sequence) for r in sync.read_looked(spark, out, "key", "string").collect()) == sorted(looked)
    of = {(r[0], r[1]): r for r in rows}
    for run in (1, 2, 3):
        want = sorted((k, s, of[k, s][3]) for r, k, s in looked if r == run and of[k, s][2] == "hit")
        assert [found for name, found in hits if name.startswith(f"{run}-") and found] == ([want] if want else [])


def test_a_run_of_several_batches_goes_on_where_the_batch_before_stood(spark, tmp_path):
    """One file a batch: misses in a row, what was seen and where a scan ended are handed from batch to batch, also when one breaks off."""
    kinds = {"a": ["miss", "miss", "hit"], "bb": ["hit", "miss"], "ccc": ["hit", "miss", "miss", "miss"], "late": ["hit", None, "miss"], "stops": ["hit", "miss", "stop", "hit"]}
    rows = [(k, i, of[i % len(of)], f"{k}{i}") for k, of in kinds.items() for i in range(1, 41) if k != "late" or i > 20]
    place, out = f"file://{tmp_path}/responses", f"file://{tmp_path}/out"
    for lo in range(1, 41, 5):
        spark.createDataFrame([r for r in rows if lo <= r[1] < lo + 5], RESPONSES).coalesce(1).write.mode("append").parquet(place)
    responses = lambda: spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", 1).parquet(place)
    hits, broken = {}, [True]

    def take(found, name):
        if broken and name == "1-2":
            broken.clear()
            raise RuntimeError("lost")
        hits[name] = [(r.key, r.sequence, r.body) for r in found.collect()]

    with pytest.raises(Exception, match="lost"):
        sync.sync(responses(), out, "key", take, 12, 3)
    for run in (1, 2):
        assert sync.sync(responses(), out, "key", take, 12, 3) == run
    state, looked = brute_sync(rows, 2, 12, 3)
    assert {r.key: (r.last_checked, r.next, r.consecutive_misses) for r in sync.read_state(spark, out, "key", "string").collect()} == state
    log = sync.read_looked(spark, out, "key", "string").collect()
    assert sorted((r.run, r.key, r.sequence) for r in log) == sorted(looked) and len({r.batch for r in log if r.run == 1}) > 2
    of = {(r[0], r[1]): r for r in rows}
    for run in (1, 2):
        assert sorted(h for name, found in hits.items() if name.startswith(f"{run}-") for h in found) == sorted((k, s, of[k, s][3]) for r, k, s in looked if r == run and of[k, s][2] == "hit")


def test_a_scan_calls_no_python_for_its_keys(spark):
    """Keys are scanned by window functions: a call of Python for each key made a sync take 5 ms a key and more."""
    rows = spark.createDataFrame([("a", s, o, "x") for s, o in ((3, "miss"), (1, "hit"), (2, "miss"), (2, "miss"), (4, "hit"), (0, "hit"))] + [("b", 7, "miss", None), ("b", 8, "hit", "y")], RESPONSES)
    state = spark.createDataFrame([("a", 1, 1, 3, False), ("b", 7, 2, 2, False)], "key string, _next long, _misses long, _seen long, _ended boolean")
    found = sync.scan(rows, state, "key", 9, 3)
    assert sorted(tuple(r) for r in found.collect()) == [("a", 1, "hit", 0, "x"), ("a", 2, "miss", 1, None), ("a", 2, "miss", 2, None), ("a", 3, "miss", 3, None), ("b", 7, "miss", 3, None)]
    assert [r.sequence for r in sync.scan(rows, state, "key", 5, 3).where("key = 'a'").orderBy("sequence").collect()] == [1, 2]  # three of five were seen before
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "Python" not in plan and "Pandas" not in plan


def test_a_sync_without_responses(spark, tmp_path):
    spark.createDataFrame([], RESPONSES).write.parquet(f"file://{tmp_path}/r")
    responses = spark.readStream.schema(RESPONSES).parquet(f"file://{tmp_path}/r")
    assert sync.sync(responses, f"file://{tmp_path}/out", "key", lambda rows, name: None) == 1
    assert sync.read_state(spark, f"file://{tmp_path}/out", "key", "string").isEmpty()


def test_snapshots_are_inserted_whole_once_and_only_where_absent(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/snap"
    rows = lambda *pairs: spark.createDataFrame(pairs, "k string, v string")
    read = lambda: {r.k: r.v for r in snapshots.read_snapshots(spark, path, "k string, v string", "k").collect()}
    assert read() == {}
    assert snapshots.insert_absent(rows(("a", "1"), ("a", "0"), ("b", "1"), (None, "x")), path, "k", "one", F.col("v")) and read() == {"a": "1", "b": "1"}

    def torn(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "rename", torn)
        with pytest.raises(RuntimeError):
            snapshots.insert_absent(rows(("b", "2"), ("c", "2")), path, "k", "two")
    assert read() == {"a": "1", "b": "1"}
    for _ in range(2):
        snapshots.insert_absent(rows(("b", "3"), ("c", "3")), path, "k", "two")
    assert read() == {"a": "1", "b": "1", "c": "3"} and len(folders.numbered(spark, path, "batch=")) == 2
    snapshots.insert_absent(rows(("b", "4")), path, "k", "three", force=True)
    assert read() == {"a": "1", "b": "4", "c": "3"}


def files_of(spark, tmp_path, names):
    for name in names:
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(name)
    rows = [(name, moves.address(f"{tmp_path}/in") + "/" + name.replace(" ", "%20"), "bad" if "bad" in name else "good") for name in names]
    return spark.createDataFrame(rows, "hash string, path string, target string")


def test_files_are_moved_once_under_free_names(spark, tmp_path, monkeypatch):
    (tmp_path / "to" / "good").mkdir(parents=True)
    for name in ("a.pdf", "a__3.pdf", "c"):
        (tmp_path / "to" / "good" / name).write_text("held")
    files = files_of(spark, tmp_path, ["1/a.pdf", "2/a.pdf", "3/a.pdf", "1/b x.pdf", "2/a__2.pdf", "bad/a.pdf", "4/c"])
    targets, log = {t: f"{tmp_path}/to/{t}" for t in ("good", "bad")}, f"file://{tmp_path}/log"
    fixed = moves.fix_intents(files, targets, log, "x").collect()
    # Broken off in the middle: two files are moved, the log of moves isn't there.
    for r in sorted(fixed, key=lambda r: r.hash)[:2]:
        target = folders.local_path(r.archived_path)
        (tmp_path / "to" / r.target).mkdir(exist_ok=True)
        (tmp_path / "in" / r.hash).rename(target)
    for _ in range(2):
        moved = {r.hash: (r.archived_path.rpartition("/")[2], r.state) for r in moves.archive(files, targets, log, "x").collect()}
        assert moved == {"1/a.pdf": ("a__4.pdf", "moved"), "2/a.pdf": ("a__5.pdf", "moved"), "3/a.pdf": ("a__6.pdf", "moved"), "1/b x.pdf": ("b%20x.pdf", "moved"), "2/a__2.pdf": ("a__2.pdf", "moved"), "bad/a.pdf": ("a.pdf", "moved"), "4/c": ("c__2", "moved")}
    assert (tmp_path / "to" / "good" / "a__5.pdf").read_text() == "2/a.pdf" and (tmp_path / "to" / "good" / "a.pdf").read_text() == "held" and (tmp_path / "to" / "good" / "b x.pdf").exists()
    (tmp_path / "to" / "bad" / "z").write_text("someone's")
    late = files_of(spark, tmp_path, ["bad/y", "bad/gone"])
    moves.fix_intents(late, targets, log, "y")
    (tmp_path / "to" / "bad" / "y").write_text("someone's")
    (tmp_path / "in" / "bad" / "gone").unlink()
    assert {r.hash: r.state for r in moves.archive(late, targets, log, "y").collect()} == {"bad/y": "name taken", "bad/gone": "missing"}
    assert (tmp_path / "to" / "bad" / "y").read_text() == "someone's" and (tmp_path / "in" / "bad" / "y").exists()


def test_ingest_by_force_and_with_an_archive(spark, tmp_path):
    box, out = tmp_path / "box", f"file://{tmp_path}/out"
    box.mkdir()
    (box / "a.txt").write_text(GOOD)
    (box / "b.txt").write_text("KETETAPAN\n")
    records = lambda: spark.read.parquet(f"{out}/records")
    jobs.ingest(spark, f"file://{box}", out)
    jobs.ingest(spark, f"file://{box}", out)
    assert records().count() == 2
    jobs.ingest(spark, f"file://{box}", out, force=True, schema='{"required": ["none"]}')
    assert records().count() == 4 and sorted(r.batch for r in records().where("batch like 'forced%'").collect()) == ["forced-1"] * 2
    current = inbox.current(records(), inbox.read_manifest(spark, f"{out}/manifest"))
    assert current.count() == 2 and all(r.batch == "forced-1" and r.status == "review" for r in current.collect())
    (box / "c.txt").write_text(GOOD + "more")
    (box / "d.txt").write_text(GOOD)
    jobs.ingest(spark, f"file://{box}", out, archive=True)
    assert sorted(p.name for p in box.iterdir()) == ["a.txt", "b.txt", "d.txt"] and (tmp_path / "out" / "archive" / "processed" / "c.txt").exists()
    jobs.ingest(spark, f"file://{box}", out, force=True, archive=True)
    assert sorted(p.name for p in box.iterdir()) == ["d.txt"]  # the second file of its content
    places = {r.source_name: (r.archived_path or "").rpartition("/")[2] for r in jobs.archived(spark, out).collect()}
    assert places == {"a.txt": "a.txt", "b.txt": "b.txt", "c.txt": "c.txt"}


def test_saved_pages_become_snapshots(spark, tmp_path):
    page = '<div>No Perkara : {}/PUU-XXIII/2025</div><div>Pokok Perkara : Hal {}</div><div>Pemohon : Rina</div><div>Kuasa Hukum : Budi</div><a href="/x?page=download.Putusan">File Putusan</a>'
    labels, box, out = {"number": "No Perkara", "title": "Pokok Perkara", "applicants": "Pemohon", "counsels": "Kuasa Hukum"}, tmp_path / "pages", f"file://{tmp_path}/out"
    box.mkdir()
    (box / "a.html").write_text(page.format(133, "A"))
    (box / "none.html").write_text("<p>nothing</p>")
    ingest = lambda force=False: [r.file_name for r in jobs.ingest_html(spark, f"file://{box}", out, labels, ["Pokok Perkara", "Pemohon", "Kuasa Hukum", "File"], "https://h.example/", force).collect()]
    raw = lambda: {r.slug: r.html for r in snapshots.read_snapshots(spark, f"{out}/raw_html", "slug string, page string, html string", "slug").collect()}
    assert ingest() == ["none.html"]
    (box / "a.html").write_text(page.format(133, "B"))
    assert ingest() == ["none.html"] and raw() == {"133_PUU-XXIII_2025": page.format(133, "A")}
    shot = snapshots.read_snapshots(spark, f"{out}/snapshots", "slug string, page string, case_number string, case_type string, year int, title string, applicants array<string>, legal_counsels array<string>, document_links array<struct<title:string,url:string,category:string,file_name:string>>", "slug").first()
    assert (shot.case_number, shot.title, shot.applicants, shot.document_links[0].url) == ("133/PUU-XXIII/2025", "Hal B", ["Rina"], "https://h.example/x?page=download.Putusan")
    ingest(True)
    assert raw() == {"133_PUU-XXIII_2025": page.format(133, "B")}


def test_a_file_is_put_by_one_writer(spark, tmp_path):
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if folders.put_new(spark, f"file://{tmp_path}/c/1", f"writer {i}") else None) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and (tmp_path / "c" / "1").read_text() == f"writer {won[0]}" and len(list((tmp_path / "c").iterdir())) == 1
    assert folders.text_of(spark, f"file://{tmp_path}/c/1") == f"writer {won[0]}"


def test_of_two_writers_one_publishes(spark, tmp_path):
    place = f"file://{tmp_path}/shelf"
    shelf, nothing = library.Library(spark, place), spark.createDataFrame([], CATALOG)
    rows = [(d, None, f"h{d}", f"{d}/PUU/2020", "putusan", "{}", None, f"{d}.pdf", b"%PDF-") for d in ("1", "2")]
    assert shelf.stage(spark.createDataFrame(rows, UPLOAD), nothing).isEmpty()
    same = [spark.createDataFrame([("1", "1/PUU/2020", "putusan", f"edit {i}")], FIELDS) for i in range(2)]
    results, gate = {}, threading.Barrier(2)

    def publish(i):
        gate.wait()
        try:
            library.Library(spark, place).publish(same[i])
            results[i] = "published"
        except library.ConflictError as failure:
            results[i] = str(failure)

    threads = [threading.Thread(target=publish, args=(i,)) for i in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(results.values()) == ["1: no such draft", "published"]
    case = shelf.cases().first()
    assert case.edits == f"edit {next(i for i, r in results.items() if r == 'published')}" and case.revision == 1 and shelf.version() == 2
    # Two writers of different drafts: the slower one looks again and is saved, too.
    shelf.publish(spark.createDataFrame([("2", "2/PUU/2020", "putusan", None)], FIELDS))
    assert shelf.cases().count() == 2 and shelf.drafts().isEmpty()


def test_a_torn_commit_is_never_seen(spark, tmp_path, monkeypatch):
    shelf = library.Library(spark, f"file://{tmp_path}/shelf")
    up = spark.createDataFrame([("1", None, "h", "1/PUU/2020", "putusan", "{}", None, "a.pdf", b"%PDF-")], UPLOAD)

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(library, "put_new", lost)
        with pytest.raises(OSError):
            shelf.stage(up, spark.createDataFrame([], CATALOG))
    assert (tmp_path / "shelf" / "drafts").exists() and shelf.drafts().isEmpty() and shelf.files().isEmpty()
    shelf.stage(up, spark.createDataFrame([], CATALOG))
    assert shelf.drafts().count() == 1 and [(r.hash, bytes(r.content)) for r in shelf.contents().collect()] == [("h", b"%PDF-")]
    # Another writer takes the next version between the check and the commit: the change is checked again.
    fields, put, first = spark.createDataFrame([("1", "1/PUU/2020", "putusan", None)], FIELDS), library.put_new, [True]

    def late(spark, path, text):
        if first:
            first.clear()
            put(spark, path, "of another")
        return put(spark, path, text)

    monkeypatch.setattr(library, "put_new", late)
    shelf.publish(fields)
    assert shelf.version() == 3 and shelf.cases().count() == 1
    plan = shelf.files()._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan


def test_a_collection_is_imported_whole_or_not_at_all(spark, tmp_path):
    entry = lambda n, sha=None, url="https://h.example/x.pdf": (f"{n}/PUU-XIX/2021", "putusan", url, f"{n}.txt", sha or f"hash{n}")
    manifest = lambda *rows: spark.createDataFrame(list(rows), "case_number string, document_type string, url string, file_name string, sha256 string")
    sha = {n: f"{n:064x}" for n in (31, 32, 33)}
    files = spark.createDataFrame([(f"{n}.txt", sha[n], GOOD.replace("31/", f"{n}/")) for n in (31, 32)] + [("33.txt", sha[33], GOOD)], "file_name string, hash string, text string")
    catalog = spark.createDataFrame([("31/PUU-XIX/2021", "putusan")], "case_number string, document_type string")
    out, hosts = f"file://{tmp_path}/out", ["h.example"]
    with pytest.raises(library.ConflictError, match="url"):
        jobs.import_collection(manifest(entry(32, sha[32], "http://h.example/x.pdf")), files, catalog, out, hosts)
    both = manifest(entry(31, sha[31]), entry(32, sha[32]))
    assert tuple(jobs.import_collection(both, files, catalog, out, hosts, dry_run=True)[0].first()) == (0, 1, 1, 0)
    counts, bad = jobs.import_collection(manifest(entry(32, sha[32]), entry(33, sha[33])), files, catalog, out, hosts)
    assert [tuple(r) for r in bad.collect()] == [("33.txt", "case number")] and tuple(counts.first()) == (0, 0, 0, 1) and not (tmp_path / "out").exists()
    facts = spark.createDataFrame([("32.txt", ("A title",))], "file_name string, document struct<title:string>")
    counts, bad = jobs.import_collection(both, files, catalog, out, hosts, facts)
    row = spark.read.parquet(out).first()
    assert bad.isEmpty() and tuple(counts.first()) == (1, 1, 0, 0) and (row.case_id, row.document.title, row.source.download_url) == ("32", "A title", "https://h.example/x.pdf")


def test_two_files_of_one_name_fail_an_entry_once(spark):
    manifest = spark.createDataFrame([("1/PUU/2020", "a.pdf", "h1"), ("2/PUU/2020", "b.pdf", "h2")], "case_number string, file_name string, sha256 string")
    files = spark.createDataFrame([("a.pdf", "h1"), ("a.pdf", "other"), ("b.pdf", "h2"), ("b.pdf", "h2")], "file_name string, hash string")
    parsed = spark.createDataFrame([("a.pdf", "1/PUU/2020"), ("b.pdf", "2/PUU/2020"), ("b.pdf", "2/PUU/2020")], "file_name string, case_number string")
    good, bad = library.import_batch(manifest, files, parsed)
    assert [r.file_name for r in good.collect()] == ["b.pdf"] and [(r.file_name, r.reason) for r in bad.collect()] == [("a.pdf", "checksum")]
