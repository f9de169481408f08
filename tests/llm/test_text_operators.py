import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillframe.llm import bpe, dart_minhash, langid, packing, substring, toxicity

TEXTS = "doc_id long, text string"
WORDS = [a + b + c for a in "klmnprst" for b in "aeiou" for c in "bdfgm"]


def prose(seed: int, n: int) -> list[str]:
    return random.Random(seed).choices(WORDS, k=n)


def docs_of(spark, rows, schema=TEXTS):
    return spark.createDataFrame(rows, schema)


# --- BPE


@pytest.fixture(scope="module")
def paths():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("byte_bpe_50k.json"), tokenizers.path("word_bpe_49k.json")


HARD = ["", " ", "\n\n  x ", "don't I'LL they've  <|endoftext|>a<|startoftext|> b", "ΑΣ ΟΔΟΣ İ ǅ", "日本語 123４５ ²", "a\xa0b c\x85d\x1cq", "👨‍👩‍👧 x" * 3, "y" * 5000, "'S 'T 're'VE", "가각 ᄀ ᅡ", "é é ½ª"]


def test_bpe_equals_the_library_and_round_trips(paths):
    from tokenizers import Tokenizer

    draw = random.Random(1)
    letters = "".join(map(chr, range(1, 256))) + " đŁ中"
    texts = HARD + ["".join(draw.choices(letters, k=120)) for _ in range(100)]
    for path, library in ((paths[0], False), (paths[1], False), (paths[1], True)):
        mine, theirs = bpe.Bpe(path, library), Tokenizer.from_file(path)
        for text in texts * 2:
            ids = np.frombuffer(mine.encode(text), "<u4").tolist()
            assert ids == theirs.encode(text, add_special_tokens=False).ids
            if path == paths[0]:
                assert mine.decode(ids) == text == theirs.decode(ids, skip_special_tokens=False)


def test_bpe_forgets_and_relearns_pieces(paths, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_ENTRIES", 3)
    a, b = bpe.Bpe(paths[0]), bpe.Bpe(paths[1], True)
    text = " ".join(prose(2, 50)) * 2
    assert a.encode(text) == bpe.Bpe(paths[0]).encode(text)
    assert b.encode(text) == bpe.Bpe(paths[1]).encode(text)


def test_merge_takes_the_lowest_rank_leftmost_and_skips_stale_entries():
    pairs = {(1, 1): (0, 2), (2, 1): (1, 3), (2, 2): (2, 4)}
    assert bpe.merge([1, 1, 1], pairs) == [3]
    assert bpe.merge([1, 1, 1, 1], pairs) == [4]
    assert bpe.merge([1], pairs) == [1]
    assert bpe.merge([], pairs) == []


def test_encode_documents_keeps_columns_and_replaces_ids(spark, paths):
    df = docs_of(spark, [(1, "a b", 5), (1, "a b", 5), (2, None, 6)], "doc_id long, text string, ids int")
    rows = bpe.encode_documents(df, paths[0]).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in rows) == [(1, (64, 275)), (1, (64, 275)), (2, ())]
    assert bpe.encode_documents(df.limit(0), paths[0]).count() == 0


# --- Packing


def check_packed(rows, window):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return len(by_sequence)


@pytest.mark.parametrize("seed", [1, 2])
def test_fill_is_the_best_subset_sum(seed):
    draw = random.Random(seed)
    for _ in range(50):
        stock = {draw.randint(1, 30): draw.randint(1, 4) for _ in range(6)}
        capacity = draw.randint(1, 80)
        reached = {0}
        for length, n in stock.items():
            for _ in range(n):
                reached |= {s + length for s in reached if s + length <= capacity}
        counts = packing.fill(stock, capacity)
        assert sum(x * n for x, n in counts.items()) == max(reached)
        assert all(n <= stock[x] for x, n in counts.items())


def test_pack_places_every_piece_once(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice([5, 5, 5, 16, 3, 7, 11, 16])) for i in range(400)] + [(0, 5), (0, 5)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, length long"), 16).collect()
    assert Counter((r.doc_id, r.length) for r in out) == Counter(rows)
    used = check_packed(out, 16)
    assert used <= -(-sum(n for _, n in rows) // 16) + 12


def test_one_length_is_numbered_by_all_tasks(spark):
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 200)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        out = packing.pack(spark.range(60_000).selectExpr("id as doc_id", "16L as length"), 16)
        assert out.selectExpr("spark_partition_id() as p").groupBy("p").count().where("count < 3000").count() >= 190
        assert out.selectExpr("count(distinct sequence_id) as n", "max(sequence_id) as m").first() == (60_000, 59_999)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pack_documents_cuts_whole_texts(spark, paths):
    from tokenizers import Tokenizer

    texts = [(1, " ".join(prose(4, 900))), (2, None), (3, ""), (4, "one two"), (4, "one two")]
    out = packing.pack_documents(docs_of(spark, texts), paths[1], 64).collect()
    check_packed(out, 64)
    library = Tokenizer.from_file(paths[1])
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out)
    want = Counter()
    for key, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 64):
            part = ids[s : s + 64]
            want[key, s, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()), len(ids)] += 1
    assert pieces == want
    assert packing.pack_documents(docs_of(spark, []), paths[1], 64).count() == 0


# --- Substring dedup


def brute_removed(rows, width):
    first = {}
    words = {}
    for key, text in rows:
        words[key] = (text or "").encode().split()
        for i in range(len(words[key]) - width + 1):
            w = tuple(words[key][i : i + width])
            first[w] = min(first.get(w, key), key)
    out = {}
    for key, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < key:
                gone[i : i + width] = [True] * width
        out[key] = [x for x, g in zip(w, gone, strict=True) if not g]
    return words, out


def by_hand(rows, width, buckets):
    """Both rounds of substring dedup in this process: {(id, which): bodies} for rows of (id, which, text)."""

    def table(rows, names):
        return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema([(n, {"id": pa.int64(), "which": pa.int64(), "text": pa.string(), "bodies": pa.list_(pa.binary())}[n]) for n in names]))

    def dealt(send, batch, choose):
        sent = pa.Table.from_batches(list(send(iter([batch]))) or [substring._batch([], ["bucket", "answer", "doc_id", "which", "body"])])
        return [r for b in substring._answer(choose)(iter(sent.sort_by("bucket").combine_chunks().to_batches())) for r in b.to_pylist()]

    named = {}
    for r in dealt(substring._send_hashes(width, buckets), table([(k, t) for k, _, t in rows], ["id", "text"]), substring._met):
        named.setdefault(r["doc_id"], []).append(r["body"])
    asked = table([(k, w, t, named.get(k)) for k, w, t in rows], ["id", "which", "text", "bodies"])
    out = {}
    for r in dealt(substring._send_digests(width, buckets), asked, substring._after_the_least):
        out.setdefault((r["doc_id"], r["which"]), []).append(r["body"])
    return out, named


def hard_rows():
    shared, hot = prose(5, 40), prose(6, 20)
    rows = [(i, " ".join(prose(10 + i, 30) + (hot if i % 3 else []) + prose(90 + i, 5) + (shared[i % 20 :] if i % 4 == 0 else []))) for i in range(40)]
    return rows + [(100, " ".join(hot * 6)), (101, rows[7][1]), (102, None), (103, ""), (104, "\t\n "), (105, " ".join(prose(7, 12))), (106, "\n".join(prose(7, 12))), (107, "x" * 10_000 + " " + "\t ".join(hot))]


@pytest.mark.parametrize("chunk,bits,sent", [(40, 64, 5), (1_000_000, 64, 5), (40, 64, 1), (40, 6, 5), (1_000_000, 6, 5)])
def test_substring_rounds_equal_brute_force_whatever_collides(monkeypatch, chunk, bits, sent):
    """Chunks of few words, hashes of which one byte is sent, and window hashes of 6 bits: all windows are named, none is removed without need."""
    whole = substring.window_hashes
    monkeypatch.setattr(substring, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(substring, "BYTES", sent)
    monkeypatch.setattr(substring, "window_hashes", lambda words, width=13: whole(words, width) & np.uint64((1 << bits) - 1))
    rows = hard_rows()
    words, kept = brute_removed(rows, 13)
    found, named = by_hand([(k, -k, t) for k, t in rows], 13, 3)
    for key, text in rows:
        n, gone, left = substring.kept_words((text or "").encode(), found.get((key, -key), []))
        assert (n, gone, left) == (len(words[key]), len(words[key]) - len(kept[key]), b" ".join(kept[key]))
    if bits == 6:
        assert len(named) == sum(len(w) >= 13 for w in words.values())


def test_substring_dedup_equals_brute_force(spark):
    rows = hard_rows()
    words, kept = brute_removed(rows, 13)
    schema = "doc_id long, text string, bodies int, _doc string, id int, which string, rest int, repeats int, named_id int, found_id int, n int, n_chars int, bucket int, body string"
    df = docs_of(spark, [(k, t, 1, "d", 2, "w", 3, 4, 5, 6, 7, None if t is None else len(t), 8, "b") for k, t in rows] * 2, schema)
    out = substring.dedup_substrings(df).collect()
    assert len(out) == 2 * len(rows) and out[0].__fields__ == df.columns
    for r in out:
        assert (r.text or "").encode().split() == kept[r.doc_id] and r.n_chars == (None if r.text is None else len(r.text))
        assert (r.bodies, r._doc, r.id, r.which, r.rest, r.repeats, r.named_id, r.found_id, r.n, r.bucket, r.body) == (1, "d", 2, "w", 3, 4, 5, 6, 7, 8, "b")
    cut = {r.doc_id: r.text for r in out}
    assert cut[102] is None and cut[0] == rows[0][1]


def test_substring_dedup_of_rows_that_share_an_id(spark):
    common, own = " ".join(prose(1, 25)), " ".join(prose(2, 50))
    df = docs_of(spark, [(None, common), (None, common), (1, common), (1, common), (2, own), (2, common), (2, own + " " + common), (3, "a " + own)])
    out = sorted(((r.doc_id or 0, r.text) for r in substring.dedup_substrings(df).collect()), key=str)
    assert out == sorted([(0, common), (0, common), (1, common), (1, common), (2, own), (2, ""), (2, own + " "), (3, "a ")], key=str)
    assert substring.dedup_substrings(docs_of(spark, [])).count() == 0


def test_rolling_window_hashes(monkeypatch):
    words = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    whole = substring.window_hashes(words, 7)
    monkeypatch.setattr(substring, "BLOCK", 16)
    assert (substring.window_hashes(words, 7) == whole).all() and len(whole) == 494
    assert (substring.window_hashes(words[100:107], 7) == whole[100]).all() and len(substring.window_hashes(words[:6], 7)) == 0


def test_substring_rounds_look_at_a_chunk_at_once(monkeypatch):
    """Words are found once for a chunk of documents, not once for each; texts beside each other keep their own words, windows and answers."""
    whole, calls = substring.word_bounds, []
    monkeypatch.setattr(substring, "word_bounds", lambda data: calls.append(len(data)) or whole(data))
    rows = hard_rows()
    words, kept = brute_removed(rows, 13)
    found, _ = by_hand([(k, -k, t) for k, t in rows], 13, 3)
    assert len(calls) == 2
    calls.clear()
    out = list(substring.kept_texts([(t or "").encode() for _, t in rows], [b"".join(found.get((k, -k), [])) for k, _ in rows]))
    assert len(calls) == 1 and any(gone for _, gone, _ in out)
    assert [(n, gone, bytes(left)) for n, gone, left in out] == [(len(words[k]), len(words[k]) - len(kept[k]), b" ".join(kept[k])) for k, _ in rows]
    assert list(substring.kept_texts([], [])) == []


def test_packed_positions_hold_for_their_text_only():
    which, doc, position = np.array([7, 7, 7, 8, 8, 7]), np.array([1, 1, 1, 1, 1, 2]), np.array([0, 1, 5, 6, 7, 8])
    docs, whiches, bodies = substring._answers(np.array([5, 0, 2, 1, 4, 3]), doc, which, position)
    assert (docs.tolist(), whiches.tolist()) == ([1, 1, 2], [7, 8, 7])
    sizes = np.array([6, 7, 8])
    hit = substring.marked(bodies.to_pylist(), sizes)  # what lies behind the end of a text isn't there, and isn't the next one's
    assert np.flatnonzero(hit).tolist() == [0, 1, 5, 6 + 6]
    assert np.flatnonzero(substring.covered(bodies.to_pylist(), sizes + 2, 3)).tolist() == [0, 1, 2, 3, 5, 6, 7, 8 + 6, 8 + 7, 8 + 8]


def test_words_longer_than_a_block(monkeypatch):
    monkeypatch.setattr(substring, "BLOCK", 8)
    data = np.frombuffer(b"aaaaaaaaaaaaaaaaaaaaaaaa bb cc aaaaaaaaaaaaaaaaaaaaaaaa bb", np.uint8)
    h = substring.word_hashes(data, *substring.word_bounds(data))
    assert h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 3


# --- MinHash


def test_signatures_estimate_weighted_similarity():
    draw = np.random.default_rng(1)
    for share in (0.3, 0.8, 0.95):
        off = []
        for _ in range(20):
            common = draw.integers(0, 2**62, int(draw.integers(1, 400))).astype(np.uint64)
            extra = int(len(common) * (1 - share) / share / 2)
            sets = []
            for _ in range(2):
                e = np.unique(np.concatenate([common, draw.integers(0, 2**62, extra).astype(np.uint64)]))
                sets.append((e, (e % np.uint64(4) + np.uint64(1)).astype(np.int64)))
            s = dart_minhash.signatures(sets, 512)
            off.append((s[0] == s[1]).mean() - dart_minhash.similarity(*sets))
        assert abs(np.mean(off)) < 0.02


def test_signatures_do_not_depend_on_the_company():
    sets = [dart_minhash.shingles(" ".join(prose(i, n))) for i, n in enumerate((1, 3, 5, 60, 3000, 40_000))]
    together = dart_minhash.signatures(sets)
    for i, s in enumerate(sets):
        assert (dart_minhash.signatures([s])[0] == together[i]).all()
    assert (together != 0).all()


def word_shingles(text, width=5):
    """A multiset of tuples of words, by plain splitting; a shorter text is one shingle."""
    words = re.split(r"[\x20\x09-\x0D]+", text or "")
    words = [w for w in words if w]
    return Counter(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else Counter()


def plain_similarity(a, b):
    both = sum((a & b).values())
    return both / ((sum(a.values()) + sum(b.values()) - both) or 1)


def brute_classes(rows):
    """Classes of near copies, from tuples of words, with no code of the operator."""
    sets = [word_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            small, large = sorted((sum(sets[i].values()), sum(sets[j].values())))
            if small >= 0.8 * large and plain_similarity(sets[i], sets[j]) >= 0.8 and find(i) != find(j):
                a, b = find(i), find(j)
                root[a if rows[b][0] < rows[a][0] else b] = b if rows[b][0] < rows[a][0] else a
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


@pytest.mark.parametrize("most", [1, 0])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(dart_minhash, "PAIRS_PER_ENTRY", most)
    monkeypatch.setattr(dart_minhash, "BLOCK", 4)
    draw, rows = random.Random(8), []
    for base in range(6):
        words = prose(base, 150)
        for k in range(12):
            w = list(words)
            for _ in range(draw.choice([0, 1, 2, 3, 8])):
                w[draw.randrange(len(w))] = draw.choice(WORDS)
            rows.append((len(rows), " ".join(w)))
    chain = prose(50, 200)
    rows += [(200 + i, " ".join(chain[: 200 - 8 * i])) for i in range(10)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one"), (304, "one"), (305, "one two"), (306, None)]
    df = spark.createDataFrame([(*r, 9, "z") for r in rows] + [(*rows[0], 9, "z")], "doc_id long, text string, component_id int, key string")
    got = {r.doc_id: r.component_id for r in dart_minhash.near_duplicates(df).collect()}
    want = brute_classes(rows)
    assert got == want and want[304] == 303 and want[306] == 306
    assert dart_minhash.near_duplicates(df).count() == len(rows) + 1
    assert dart_minhash.near_duplicates(df.limit(0)).count() == 0


def test_near_copies_of_rows_that_share_an_id(spark):
    a, b = prose(1, 60), prose(2, 60)
    a2, a, b = " ".join([*a[:59], "x"]), " ".join(a), " ".join(b)
    rows = [(2, a), (2, b), (1, a2), (2, b), (3, b), (4, None), (4, None), (None, a), (None, a), (5, "a"), (5, None), (6, "z"), (6, "y"), (7, "y")]
    schema = "doc_id long, text string, id int, digest string, row int, root int, node int, first int, component_id int, leader int"
    df = docs_of(spark, [(*r, 1, "d", 2, 3, 4, 5, 6, 7) for r in rows], schema)
    got = sorted(dart_minhash.near_duplicates(df).collect(), key=str)
    want = [(2, 1), (2, 2), (1, 1), (2, 2), (3, 2), (4, 4), (4, 4), (None, None), (None, None), (5, 5), (5, 5), (6, 6), (6, 6), (7, 6)]
    assert got == sorted(want, key=str) or sorted(map(tuple, got), key=str) == sorted(want, key=str)
    kept = dart_minhash.without_near_copies(df)
    assert kept.columns == df.columns
    left = sorted(map(tuple, kept.collect()), key=str)
    assert left == sorted([(k, t, 1, "d", 2, 3, 4, 5, 6, 7) for k, t in [(2, b), (1, a2), (4, None), (None, a), (5, "a"), (5, None), (6, "z"), (6, "y")]], key=str)
    assert dart_minhash.without_near_copies(df.limit(0)).count() == 0


def test_near_copies_leave_little_behind(spark):
    """Scratch tables that the result doesn't read are deleted."""
    folder = spark.conf.get("spark.checkpoint.dir")
    files = lambda: set(os.listdir(folder.removeprefix("file://")))
    before = files()
    out = dart_minhash.near_duplicates(docs_of(spark, [(i, " ".join(prose(i // 2, 30)) + f" {i}") for i in range(20)]))
    assert len(files() - before) <= 2 and out.where("component_id = doc_id").count() == 10


def test_block_links_join_what_all_pairs_would(monkeypatch):
    monkeypatch.setattr(dart_minhash, "SLICE", 16)
    draw, words, rows = random.Random(2), prose(1, 80), []
    for i in range(60):
        w = list(words)
        for _ in range(draw.choice([1, 3, 5])):
            w[draw.randrange(80)] = draw.choice(WORDS)
        rows.append((i % 2, i, i, " ".join(w)))
    root = list(range(60))

    def find(i):
        return i if root[i] == i else find(root[i])

    def classes(pairs):
        root[:] = range(60)
        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(60)]

    sets = [word_shingles(r[3]) for r in rows]
    for blocks in (1, 2):
        used = [(0 if blocks == 1 else b, *rest) for b, *rest in rows]
        want = [(i, j) for i in range(60) for j in range(i) if plain_similarity(sets[i], sets[j]) >= 0.8 and (blocks == 1 or i % 2 != j % 2)]
        assert classes(dart_minhash.block_links(used, 0.8, 5)) == classes(want)


# --- Language and toxicity


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 30):
        code = langid.codewords(n)
        assert code.shape[0] == n and (np.abs(code.sum(axis=0)) < n).all()
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 1


def test_language_identification(spark):
    alphabets = {"aa": "abcde", "bb": "cdefg", "cc": "ghijk"}
    draw, rows = random.Random(4), []
    for i in range(240):
        lang = draw.choice(sorted(alphabets))
        rows.append((i, " ".join("".join(draw.choices(alphabets[lang], k=5)) for _ in range(30)), lang))
    df = spark.createDataFrame([*rows, (500, None, "aa"), (501, "", None), (502, "123 --", "bb"), (503, "abeda", None)], "doc_id long, text string, lang string")
    model = langid.fit(langid.training_rows(df))
    assert model.languages == ["aa", "bb", "cc"]
    found = {r.doc_id: r for r in langid.identify(df.withColumn("score", df.doc_id), model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([found[r[0]].lang_pred == r[2] for r in held]) > 0.97
    assert all(found[k].lang_pred == "und" and found[k].score == 0.0 and found[k].ambiguous for k in (500, 501, 502))
    assert found[503].lang_pred == "aa" and all(0 <= r.score <= 1 for r in found.values())
    nothing = langid.fit(langid.training_rows(df.limit(0)))
    assert nothing.predict(["abc", None]) == [("und", 0.0)] * 2
    one = langid.fit_rows(np.ones((3, 8192), np.float32), ["aa"] * 3)
    assert one.predict(["abc", "1"]) == [("aa", 1.0), ("und", 0.0)]


def test_toxicity(spark):
    draw, rows, labels = random.Random(6), [], []
    for i in range(400):
        words, toxic = prose(i, 60), i % 4 == 0
        if toxic:
            words[draw.randrange(60)] = draw.choice(["vorxhul", "vorxhuls", "zzquaj"])
        rows.append((i, " ".join(words), 3))
        labels.append((i, int(toxic)))
    labels += [(7, None), (None, 1), (3, 1), (9999, 1)]
    df = spark.createDataFrame([*rows, (900, None, 1), (901, "", 1), (902, "vorxhul " * 3000, 1)], "doc_id long, text string, score int")
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(df, marked))
    found = {r.doc_id: r.score for r in toxicity.score_texts(df, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(found[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.95
    assert found[900] == found[901] < 0.5 < found[902]
    assert toxicity.fit(toxicity.training_rows(df, marked.limit(0))).score("x") == 0.5
    only = toxicity.fit(toxicity.training_rows(df, spark.createDataFrame([(i, 0) for i in range(50)], "doc_id long, toxic int")))
    assert 0 < only.score("vorxhul") < 0.1


def test_ngrams_of_short_and_long_texts():
    assert len(toxicity.ngrams(None)) == 0 and len(toxicity.ngrams("a")) == 1
    n = len(" éa ")
    assert len(toxicity.ngrams("ÉA")) == sum(max(0, n - k + 1) for k in toxicity.ORDERS)
    assert set(toxicity.ngrams("中文字")) < set(toxicity.ngrams("中文字 中文字"))


def hashed(codes, orders, finish):
    """(order, bucket) of every n-gram, by plain integers; n-grams of one order come together."""
    out = []
    for n in orders:
        for i in range(len(codes) - n + 1):
            h = codes[i]
            for c in codes[i + 1 : i + n]:
                h = (h * 0x01000193 + c) % 2**32
            out.append((n, finish(h, n)))
    return out


def test_language_model_equals_a_plain_one():
    """Dense vectors, a ridge solved anew for every left-out row, and losses added bit by bit."""
    draw, alphabets = random.Random(3), {"aa": "abcdef", "bb": "defghi", "cc": "ghijkl"}
    texts = [(lang, " ".join("".join(draw.choices(letters, k=4)) for _ in range(6))) for lang, letters in alphabets.items() for _ in range(9)]

    def vector(text):
        x, codes = np.zeros(4 * 2048), text.encode()
        for n in langid.ORDERS:
            found = Counter(b for _, b in hashed(codes, [n], lambda h, _: ((h ^ h >> 15) * 0x2C1B3C6D) % 2**32 >> 21))
            for b, k in found.items():
                x[(n - 1) * 2048 + b] = (k / sum(found.values())) ** 0.5
        return x / np.linalg.norm(x)

    x = np.stack([vector(t) for _, t in texts])
    words = {"aa": [1, -1, 1], "bb": [-1, 1, 1], "cc": [-1, -1, -1]}
    words = {lang: langid.codewords(3)[k].tolist() for k, lang in enumerate(words)}
    y = np.asarray([words[lang] for lang, _ in texts], float)
    bias, ridge = y.reshape(3, 9, 3).mean(axis=1).mean(axis=0), langid.PENALTY * len(x) / 10

    def solved(rows, target):
        return rows.T @ np.linalg.solve(rows @ rows.T + ridge * np.eye(len(rows)), target - bias)

    left = np.stack([x[i] @ solved(np.delete(x, i, 0), np.delete(y, i, 0)) + bias for i in range(len(x))])
    wrong = np.clip((left * y <= 0).mean(axis=0), 1e-3, 0.5)
    trust = np.log((1 - wrong) / wrong) + 1e-6
    trust *= 3 / trust.sum()

    def losses(margins):
        return np.asarray([sum(t * np.log1p(np.exp(-2 * m * w)) for m, w, t in zip(margins, word, trust, strict=True)) for word in words.values()])

    def surprise(sharp):
        return np.mean([np.log(sum(np.exp(-sharp * losses(m)))) + sharp * losses(m)[list(words).index(lang)] for m, (lang, _) in zip(left, texts, strict=True)])

    sharp = min((0.25, 0.5, 1.0, 2.0, 4.0, 8.0), key=surprise)
    model = langid.fit_rows(np.stack([langid.features(t) for _, t in texts]), [lang for lang, _ in texts])
    assert model.sharpness == sharp
    weights = solved(x, y)
    tries = [t for _, t in texts[::4]] + ["abc ghi", "fff", "kla dea"]
    for text, (lang, score) in zip(tries, model.predict(tries), strict=True):
        loss = losses(vector(text) @ weights + bias)
        share = np.exp(-sharp * loss) / np.exp(-sharp * loss).sum()
        assert lang == list(words)[int(loss.argmin())] and abs(score - share.max()) < 1e-3


def test_toxicity_model_equals_a_plain_one(spark, monkeypatch):
    """Counts in dictionaries, all n-grams ranked at once, and a regression over a dense matrix by the same steps."""
    draw = random.Random(5)
    texts = [(i, " ".join(draw.choices(["lorem", "Ipsum", "dolor", "vorx", "sít"], weights=[5, 4, 4, 3 if i % 3 == 0 else 0.3, 2], k=7)), int(i % 3 == 0)) for i in range(45)]
    grams = lambda t: set(hashed([ord(c) for c in f" {t.lower()} "], toxicity.ORDERS, lambda h, n: (((h + n * 0x9E3779B1) % 2**32 ^ (h + n * 0x9E3779B1) % 2**32 >> 15) * 0x2C1B3C6D) % 2**32 >> 12))
    docs = [{b for _, b in grams(t)} for _, t, _ in texts]
    label = np.asarray([y for *_, y in texts])
    size = [int((label == k).sum()) for k in (0, 1)]
    count = [Counter(b for d, y in zip(docs, label, strict=True) if y == k for b in d) for k in (0, 1)]

    def spread(b):
        rate = (count[0][b] + count[1][b]) / sum(size)
        return abs(count[1][b] / size[1] - count[0][b] / size[0]) / max(rate * (1 - rate) * (1 / size[0] + 1 / size[1]), 1e-12) ** 0.5

    kept = sorted(count[0] | count[1], key=lambda b: (-spread(b), b))[: toxicity.FEATURES]
    ratio = np.asarray([np.log((count[1][b] + 1) / (sum(count[1].values()) + 2**20)) - np.log((count[0][b] + 1) / (sum(count[0].values()) + 2**20)) for b in kept])
    x = np.asarray([[b in d for b in kept] for d in docs]) * ratio
    weight, w, c = np.ones(len(x)) / len(x), np.zeros(len(kept)), 0.0
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, toxicity.STEPS + 1):
        off = (1 / (1 + np.exp(-(x @ w + c))) - label) * weight
        slope = np.append(x.T @ off + toxicity.PENALTY * w, off.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        move = 0.05 * (m / (1 - 0.9**step)) / ((v / (1 - 0.99**step)) ** 0.5 + 1e-8)
        w, c = w - move[:-1], c - move[-1]
    model = toxicity.fit(spark.createDataFrame(texts, "id long, text string, label int").repartition(3))
    tries = [t for _, t, _ in texts[:6]] + ["vorx", "", "lorem vorx sít"]
    for text in tries:
        found = {b for _, b in grams(text)}
        assert abs(model.score(text) - 1 / (1 + np.exp(-sum(u * r for b, u, r in zip(kept, w, ratio, strict=True) if b in found) - c))) < 1e-4


@pytest.mark.parametrize("rows,count,each", [(1000, 10**10, 5 * 10**6), (400_000, 10**10, 25 * 10**6), (400_000, 10**13, 10**10)])
def test_samples_of_very_large_groups(spark, rows, count, each):
    """With counts as of a very large table, a part of its rows gives its share of the sample; a small group comes whole."""
    from quillframe.llm.common import draw_rows

    df = spark.range(rows).selectExpr("id", "'t' || id as text", "if(id % 2 = 0, 'big', 'small') as lang")
    drawn = draw_rows(df, "lang", {"big": count, "small": each}, each).groupBy("lang").count().collect()
    found = {r["lang"]: r["count"] for r in drawn}
    want = rows / 2 * each / count
    assert found["small"] == rows / 2 and abs(found.get("big", 0) - want) <= 5 * want**0.5 + 1


def test_a_row_repeated_very_often_is_drawn_once(spark):
    from quillframe.llm.common import draw_rows

    df = spark.range(20_000).selectExpr("1L as id", "'same' as text", "0 as label").union(spark.range(100).selectExpr("id + 5", "'t' || id", "0"))
    assert draw_rows(df, "label", {0: 20_100}, 20_100).count() == 101
