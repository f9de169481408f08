"""Queries over whole texts and tables, against brute force on small tables."""

import datetime
import hashlib

from quillframe.plans import registry


def test_distinct_words_of_whole_texts(spark, tmp_path):
    texts = ["", " ".join(f"{'W' if i % 3 else 'w'}{i % 90}" for i in range(400)), "a  B\nA b c", " ".join(f"x{i}" for i in range(3000))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.words_md5, r.n) for r in registry.QUERIES["ordered_distinct"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        first = {}
        for word in text.split() or [""]:
            first.setdefault(word.lower(), word)
        assert got[i] == (hashlib.md5(" ".join(first.values()).encode()).hexdigest(), len(first))
    assert got[3][1] == 3000


def test_newest_orders_to_the_end(spark, tmp_path):
    rows = [(i, "P" if i % 4 == 0 else "O", datetime.date(2020, 1, 1) + datetime.timedelta(i % 37)) for i in range(300)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    got = [(r.o_orderkey, r.decision_date) for r in registry.QUERIES["sort_newest_nulls_last"](spark, str(tmp_path)).collect()]
    dated = sorted(((d.isoformat(), str(k), k) for k, s, d in rows if s != "P"), reverse=True)
    assert got == [(k, d) for d, _, k in dated] + [(k, None) for k, s, _ in rows if s == "P"]


def test_turns_are_compared_whole(spark, tmp_path):
    texts = {1: ["p" * 70 + "a", "p" * 70 + "b", "short"], 2: ["a" + " " * 30 + "b" * 60, "c", "C", "", None, "d", "e"], 3: [""]}
    rows = [(c, i, t) for c, turns in texts.items() for i, t in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.hidden, r.n_shown) for r in registry.QUERIES["display_compact"](spark, str(tmp_path)).collect()}
    for conv, turns in texts.items():
        distinct = {" ".join((t or "").split()).lower() for t in turns} - {""}
        shown = min(2, sum(len(t) <= 50 for t in distinct))
        assert got[conv] == (len(distinct) - shown, shown)
