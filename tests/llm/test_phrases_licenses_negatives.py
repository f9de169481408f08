"""Collocations, license scans and hard negatives against brute force, with nulls, long texts, ties and repeated rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quillframe.llm import collocations, hard_negatives, licenses

SHARED = [["the", "quick", "fox"], ["New", "York"], ["in", "spite", "of", "all", "that"], ["daß", "ist", "es"]]


def prose(seed, n):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["the"] * 20 + ["é", "日本", "a\x1cb", "x y"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(draw.randrange(0, 60)):
            words += draw.choice(SHARED) if draw.random() < 0.3 else [draw.choice(vocabulary)]
        text = "".join(w + draw.choice([" ", " ", " ", "\t ", ", ", ".\n", ";", "  "]) for w in words)
        rows.append((i, draw.choice(["en", "en", "fr", None]), text))
    rows += [(9001, "en", None), (9002, "en", ""), (9003, None, " ,.; "), (9004, "en", "the " * 5000), (9005, "xx", "only once")]
    return [*rows, rows[0], rows[0]]


def brute_collocations(rows, least, width, top, subsumed=100):
    out = []
    for lang in {r[1] or "und" for r in rows}:
        f, n = Counter(), 0
        for _, of, text in rows:
            if (of or "und") != lang:
                continue
            lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
            for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
                words = [w for w in re.split(r"[ \t]+", piece) if w]
                n += len(words)
                f.update(tuple(words[i : i + k]) for k in range(1, width + 1) for i in range(len(words) - k + 1))
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(a, inside.get(p[i : i + k], 0))
        found = []
        for p, a in candidates.items():
            if 100 * inside.get(p, -1) >= subsumed * a:
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("chunk,size,width", [(1_000_000, 16_000_000, 5), (700, 300, 5), (90, 40, 4), (300, 2000, 2)])
def test_collocations_equal_brute_force(spark, monkeypatch, chunk, size, width):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    rows = prose(width, 400)
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, lang string, text string, rank int, n string").repartition(5)
    got = collocations.collocations(df, least=12, max_words=width, top=25, range_bytes=size)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, 12, width, 25)


def test_phrases_across_ranges_are_summed(spark):
    rows = [(i, "en", "so it goes on and so it ends here") for i in range(60)] + [(99, "en", f"so it goes {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    borders = collocations.range_borders(df, 5, 30)
    assert len(borders) > 10 and borders == sorted(set(borders))
    counts = {r.phrase: r.n for r in collocations.phrase_counts(df, least=60, range_bytes=30).collect()}
    assert counts["so it"] == 180 and counts["so it goes"] == 120 and counts["so"] == 180 and counts[""] == 60 * 9 + 60 * 4 and counts["it goes on and so"] == 60
    assert all(n >= 60 for n in counts.values())


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame(prose(1, 3), "doc_id long, lang string, text string")
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df.where("doc_id in (9001, 9002, 9003)")).count() == 0


def test_collocation_scores_pass_64_bits(spark):
    """(1000 a n) of 10^19 and more, through the same expression."""
    wide = spark.range(1).selectExpr("(cast(1000 as decimal(4,0)) * cast(3000000000 as decimal(19,0)) * cast(9000000000000 as decimal(19,0))) div (cast(3000000001 as decimal(19,0)) * cast(4000000000 as decimal(19,0))) as s")
    assert wide.first().s == 1000 * 3000000000 * 9000000000000 // (3000000001 * 4000000000)


def test_one_stack_counts_all_prefixes():
    rows = [((1, 2, 3), 2), ((1, 2, 0), 3), ((1, 3, 0), 1), ((2, 0, 0), 4)][::-1]
    columns, counts = np.asarray([r for r, _ in rows]).T, np.asarray([n for _, n in rows])
    order = np.lexsort(columns[::-1])[::-1]
    found = {(tuple(columns[:k, order][:, i]), n) for i, k, n in collocations.prefix_counts(columns[:, order], counts[order], 1)}
    assert found == {((), 10), ((1,), 6), ((1, 2), 5), ((1, 2, 3), 2), ((1, 3), 1), ((2,), 4)}


MIT = licenses.TEMPLATES[7].markup


def plain(markup, optional=True):
    """A text that a template accepts: with its optional wording or without, replaceable wording as in the original."""
    text = re.sub(r'<<var;name="[^"]*";original="([^"]*)".*?>>', r"\1", markup)
    return re.sub("<<.*?>>", " ", text if optional else re.sub("<<beginOptional>>.*?<<endOptional>>", " ", text, flags=re.DOTALL))


def test_every_template_accepts_its_own_wording():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for k, t in enumerate(licenses.TEMPLATES):
        for optional in (True, False):
            words = licenses.words_of(plain(t.markup, optional))
            assert k in [m[0] for m in scanner.find([b"before", *words, b"after"])], t
    words = licenses.words_of(plain(MIT))
    assert [(a, z) for t, a, z in scanner.find([b"x", *words, b"y"]) if t == 7] == [(1, len(words))]
    for gone in range(0, len(words), 9):
        if words[gone] not in (b"this", b"and", b"associated", b"documentation", b"files", b"including", b"the", b"next", b"paragraph", b"authors", b"or", b"copyright", b"holders", b"software"):
            assert 7 not in [m[0] for m in scanner.find(words[:gone] + words[gone + 1 :])], words[gone]


def brute_matches(template, words):
    """All (first, last) of a template by a regular expression on every pair of places; of one first the longest, of one last the first."""
    pattern = ""
    for i, part in enumerate(re.split(r"<<(.*?)>>", template.markup)):
        if i % 2 == 0:
            pattern += "".join(re.escape(w.decode()) + " " for w in licenses.words_of(part))
        elif part == "beginOptional":
            pattern += "(?:"
        elif part == "endOptional":
            pattern += ")?"
        else:
            match = re.search('match="(.*?)"', part)[1]
            pattern += {".+": "(?:[^ ]+ ){1,3}", ".*": "(?:[^ ]+ ){0,3}"}.get(match, f"(?:(?:{match}) ){{1,3}}")
    ends, longest = {}, {}
    for a in range(len(words)):
        for z in range(a, len(words)):
            if re.fullmatch(pattern, "".join(w.decode() + " " for w in words[a : z + 1])):
                ends.setdefault(z, a)
    for z, a in ends.items():
        longest[a] = max(z, longest.get(a, -1))
    return sorted(longest.items())


def test_matches_equal_regular_expressions():
    templates = [
        licenses.Template("a", "x <<beginOptional>>y <<beginOptional>>z<<endOptional>><<endOptional>> x"),
        licenses.Template("b", 'y <<var;name="n";original="";match=".+">> y'),
        licenses.Template("c", '<<beginOptional>>x<<endOptional>> z <<var;name="n";original="";match="[0-9]+">>'),
        licenses.Template("d", 'x <<var;name="n";original="";match=".*">> z <<beginOptional>>y<<endOptional>>'),
        licenses.Template("e", "x y", base=True),
    ]
    scanner, draw = licenses.Scanner(templates, var_words=3), random.Random(5)
    for _ in range(400):
        words = [draw.choice([b"x", b"y", b"z", b"7", b"12", b"q"]) for _ in range(draw.randrange(0, 14))]
        want = sorted((k, *m) for k, t in enumerate(templates) for m in brute_matches(t, words))
        assert scanner.find(words) == want


@pytest.mark.parametrize("markup", ["<<beginOptional>>x<<endOptional>>", "", '<<var;name="n";original="";match=".*">>', "<<beginOptional>> x", "x <<endOptional>>", "x <<unknown>>"])
def test_faulty_templates_are_errors(markup):
    with pytest.raises(ValueError):
        licenses.Scanner([licenses.Template("t", markup)])


def test_license_scan_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "... !"), (4, "MIT-License; mit_license"), (5, "mit licensé"), (6, "word " * 200_000 + "the GENERAL public license"), (7, "mit mit license"), (7, "mit mit license")]
    df = spark.createDataFrame([(*r, 5, "p") for r in rows], "doc_id long, text string, n_words int, label string")
    out = licenses.scan_licenses(df)
    assert out.columns == ["doc_id", "text", "label", "n_words", "places"]
    got = [(r.doc_id, r.n_words, [(p.label, p.base, p["first"], p["last"]) for p in r.places]) for r in out.orderBy("doc_id").collect()]
    assert got == [(1, 0, []), (2, 0, []), (3, 0, []), (4, 4, [("mit", True, 0, 1), ("mit", True, 2, 3)]), (5, 2, []), (6, 200_004, [("gpl", True, 200_001, 200_003)]), (7, 3, [("mit", True, 1, 2)]), (7, 3, [("mit", True, 1, 2)])]
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_an_automaton_that_grew_too_large_is_made_anew(monkeypatch):
    monkeypatch.setattr(licenses, "MOST_STATES", 3)
    scanner = licenses.Scanner(licenses.PHRASES)
    for _ in range(5):
        assert scanner.find([b"general", b"public", b"license", b"mit", b"license"]) == [(0, 3, 4), (2, 0, 2)]


def brute_negatives(rows, positives=5, negatives=5, low=80, high=100):
    rows = {k: (label, v) for k, label, v in sorted(rows, key=str) if label is not None and k is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(rows[a][1], rows[b][1], strict=True))
    for a in rows:
        if a % 10:
            continue
        same = sorted((-score(a, b), b) for b in rows if b != a and rows[b][0] == rows[a][0] and len(rows[b][1]) == len(rows[a][1]))
        other = sorted((-score(a, b), b) for b in rows if rows[b][0] != rows[a][0] and len(rows[b][1]) == len(rows[a][1]))
        for p, pid in same[:positives]:
            inside = [(s, b) for s, b in other if low * -p <= 100 * -s <= high * -p]
            out += [(a, pid, i + 1, b, -p, -s) for i, (s, b) in enumerate(inside[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("block,cells", [(4096, 64), (16, 3)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, cells):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", block)
    draw = np.random.default_rng(cells)
    x = np.floor(draw.standard_normal((300, 6)) * 9)
    x[50:90] = x[10]  # ties
    rows = [(i, int(draw.integers(0, 3)), [float(e) for e in v]) for i, v in enumerate(x)]
    rows += [(400, None, [1.0] * 6), (410, 1, None), (420, 1, []), (430, 1, [float("nan")] * 6), (440, 1, [float("inf")] * 6), (450, 1, [0.0] * 6), (460, 1, [1.0, None] * 3), (470, 1, [3.0] * 4), (480, 2, [3.0] * 4), (490, 1, [2.0] * 4), (None, 1, [9.0] * 6)]
    df = spark.createDataFrame([(*r, 1, 2) for r in [*rows, rows[20], rows[3]]], "vec_id long, label long, embedding array<double>, rank int, anchor_id int").repartition(4)
    got = hard_negatives.hard_negatives(df, df.vec_id % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)
    assert hard_negatives.hard_negatives(df.limit(0), df.vec_id % 10 == 0).count() == 0
    assert hard_negatives.hard_negatives(df, df.vec_id < 0).count() == 0


def test_of_rows_that_share_a_key_the_smallest_counts(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [2.0, 0.0]), (1, 0, [9.0, 9.0]), (2, 1, [1.0, 1.0]), (3, 2, [0.9, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    assert [tuple(r) for r in hard_negatives.hard_negatives(df, df.vec_id == 0).collect()] == [(0, 2, 1, 3, 1.0, 0.9)]


def test_bounds_hold_and_prune():
    draw = np.random.default_rng(1)
    x, a = draw.standard_normal((2000, 16)), draw.standard_normal((20, 16))
    borders, codes = hard_negatives.quantised(x)
    lower, upper = hard_negatives.bounds(a, borders, codes)
    exact = a @ x.T
    assert (lower <= exact).all() and (exact <= upper).all() and (upper - lower).mean() < 0.1 * np.ptp(exact)
    able = np.ones(exact.shape, bool)
    assert hard_negatives._may_enter(able, able, lower, upper, 5).mean() < 0.03


def test_copies_of_anchors_are_never_broadcast(spark, monkeypatch):
    """Wards and parts keep every meeting, and none of the joins sends the anchors, copied for each part, through the driver."""
    for name, value in {"BLOCK": 8, "ANCHORS": 4, "ANCHOR_BYTES": 400}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    met, plans = hard_negatives._meetings, []
    monkeypatch.setattr(hard_negatives, "_meetings", lambda *a: [plans.append(m._jdf.queryExecution().executedPlan().toString()) or m for m in [met(*a)]][0])
    x = np.floor(np.random.default_rng(7).standard_normal((200, 6)) * 9)
    rows = [(i, i % 3, [float(e) for e in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    assert sorted(map(tuple, hard_negatives.hard_negatives(df, df.vec_id % 10 == 0).collect())) == brute_negatives(rows)
    assert len(plans) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
