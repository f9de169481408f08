"""The registered queries and the pipeline against brute force, on the smallest tables and on tables of our own."""

import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from quillframe.llm import dart_minhash, langid, registry, toxicity

from .test_text_operators import WORDS, brute_classes, brute_removed, check_packed, prose

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def read(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@needs_tables
def test_op7_equals_the_library(spark):
    tokenizers, places = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(places.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in registry.QUERIES["op7_bpe"](spark, SF).collect()}
    docs = read("documents")
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@needs_tables
def test_op9_packs_the_library_s_ids(spark):
    tokenizers, places = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(places.path("word_bpe_49k.json"))
    rows = registry.QUERIES["op9_packing"](spark, SF).collect()
    used = check_packed(rows, 2048)
    tokens, docs = 0, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
    for d in read("documents"):
        ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        tokens += len(ids)
        at = 0
        for r in sorted(docs.pop(d["doc_id"]), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not docs and used <= -(-tokens // 2048) + 1


@needs_tables
def test_op10_equals_brute_force(spark):
    rows = [(d["doc_id"], d["text"]) for d in read("documents")]
    got = {r.doc_id: (r.component_id, r.kept) for r in registry.QUERIES["op10_minhash_dedup"](spark, SF).collect()}
    assert got == {k: (v, k == v) for k, v in brute_classes(rows).items()}


@needs_tables
def test_op3_and_op6_on_held_out_rows(spark):
    docs, labels = {d["doc_id"]: d for d in read("documents")}, {r["doc_id"]: r["toxic"] for r in read("labels")}
    split = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    language = registry.QUERIES["op3_langid"](spark, SF).collect()
    assert {r.doc_id for r in language} == set(docs) and all(r.held_out == split(r.doc_id) and 0 <= r.score <= 1 for r in language)
    assert np.mean([r.lang_pred == docs[r.doc_id]["lang"] for r in language if r.held_out]) > 0.95
    toxic = registry.QUERIES["op6_toxicity"](spark, SF).collect()
    assert {r.doc_id for r in toxic} == set(docs) and all(r.held_out == split(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in toxic)
    assert np.mean([r.predicted == labels[r.doc_id] for r in toxic if r.held_out and r.doc_id in labels]) > 0.8


def write(folder, name, rows, schema):
    pq.write_table(pa.Table.from_pylist(rows, schema), f"{folder}/{name}.parquet")


DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    folder, draw, docs = tmp_path_factory.mktemp("corpus"), random.Random(1), []
    passage = prose(70, 25)

    def add(words, lang="aa"):
        text = words if isinstance(words, str) or words is None else " ".join(words)
        docs.append({"doc_id": len(docs), "text": text, "lang": lang, "source": f"s{len(docs) % 3}", "n_chars": len(text or "")})

    for i in range(160):
        words = prose(i, 70)
        if i % 5 == 0:
            words[9] = draw.choice(["vorxhul", "zzquaj"])
        if i % 6 == 1:
            words[30:30] = passage
        add(words)
    for i in range(40):
        add(["".join(draw.choices("öüäwxyzv", k=6)) for _ in range(60)], "bb")
    for i in (2, 3, 4):
        near = docs[i]["text"].split()
        near[60] = draw.choice(WORDS)
        add(near)
        add(docs[i]["text"])
    add(None)
    add("12 34 --")
    add("")
    write(folder, "documents", docs, DOCS)
    write(folder, "labels", [{"doc_id": d["doc_id"], "quality": 1, "toxic": int(d["doc_id"] < 160 and d["doc_id"] % 5 == 0)} for d in docs if d["doc_id"] % 10 < 8], LABELS)
    return f"file://{folder}", docs


def test_pipeline_equals_brute_force(spark, corpus):
    pytest.importorskip("public_tokenizers")
    folder, docs = corpus
    table = spark.read.parquet(f"{folder}/documents.parquet")
    after = {}
    rows = table
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, folder)
        after[name] = rows.collect()
        rows = spark.createDataFrame(after[name], rows.schema)
        if name != "packing":
            assert rows.columns == table.columns
    kept = {name: {r.doc_id: r for r in found} for name, found in after.items() if name != "packing"}

    model = toxicity.fit(toxicity.training_rows(table, spark.read.parquet(f"{folder}/labels.parquet")))
    clean = [d for d in docs if model.score(d["text"]) < 0.5]
    assert set(kept["toxicity"]) == {d["doc_id"] for d in clean} and not [k for k in kept["toxicity"] if k < 160 and k % 5 == 0]

    languages = langid.fit(langid.training_rows(spark.createDataFrame(after["toxicity"], table.schema)))
    found = dict(zip([d["doc_id"] for d in clean], languages.predict([d["text"] for d in clean]), strict=True))
    spoken = [d for d in clean if found[d["doc_id"]][0] != "und" and found[d["doc_id"]][1] >= langid.AMBIGUOUS]
    assert set(kept["language"]) == {d["doc_id"] for d in spoken} and len(docs) - 1 not in kept["language"]

    classes = brute_classes([(d["doc_id"], d["text"]) for d in spoken])
    unique = [d for d in spoken if classes[d["doc_id"]] == d["doc_id"]]
    assert set(kept["near_dedup"]) == {d["doc_id"] for d in unique} and len(unique) < len(spoken)

    words, left = brute_removed([(d["doc_id"], d["text"]) for d in unique], 13)
    assert {k: r.text.encode().split() for k, r in kept["substring_dedup"].items()} == left and left != words
    assert all(r.n_chars == len(r.text) for r in kept["substring_dedup"].values())

    check_packed(after["packing"], 2048)
    assert {r.doc_id for r in after["packing"]} == set(left)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, after["packing"]))


CLASHING = ["score", "_score", "lang_pred", "ambiguous", "row", "id", "digest", "component_id", "which", "rest", "repeats", "bodies", "_doc", "_rank", "sequence_id", "offset", "length", "start"]


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0])
def test_stages_keep_columns_of_any_name(spark, corpus, stage):
    """Nulls, empty texts, repeated rows and columns named like added or private ones, in every stage."""
    pytest.importorskip("public_tokenizers")
    folder, _ = corpus
    table = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", *[f"concat('{c}', doc_id) as {c}" for c in CLASHING])
    rows = table.union(table.where("doc_id in (7, 8)")).union(table.limit(1).selectExpr("null as doc_id", "null as text", *table.columns[2:]))
    out = stage[1](spark, rows, folder)
    if stage[0] == "packing":
        assert out.where("doc_id = 7").select("start").distinct().count() * 2 == out.where("doc_id = 7").count()
        return
    assert out.columns == table.columns
    found = out.where("doc_id is not null").collect()
    assert len(found) > 100 and all(r[c] == f"{c}{r.doc_id}" for r in found for c in CLASHING)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    write(tmp_path, "documents", [], DOCS)
    write(tmp_path, "labels", [], LABELS)
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_near_copies_of_one_text_in_two_tables_share_keys():
    """Signatures depend on the text alone, so tables of different days can be compared."""
    a, b = (dart_minhash.band_keys(dart_minhash.signatures([dart_minhash.shingles(" ".join(prose(5, 90)))])) for _ in range(2))
    assert (a == b).all()
