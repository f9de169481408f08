import math

import numpy as np
import pytest

from quillframe.llm import ann, cap_filters, components, sharding, url_filter

VECTORS = "vec_id long, embedding array<float>"
ODD = [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [1.0, None] + [0.0] * 14), (9005, [float("nan")] + [1.0] * 15), (9006, [float("inf")] + [1.0] * 15)]


def vectors(seed: int, n: int, dim: int = 16, copies: int = 0) -> list[tuple[int, list[float]]]:
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((n, dim))
    for i in range(copies):
        x[n - 1 - i] = x[i % 3] * draw.uniform(0.5, 2) + draw.standard_normal(dim) * 0.12 * (i % 4)
    return [(i, [float(v) for v in np.float32(row)]) for i, row in enumerate(x)]


def brute_links(rows, threshold=0.9):
    rows = [(k, np.asarray(v, np.float64)) for k, v in rows if v and all(e is not None and math.isfinite(e) for e in v) and any(v)]
    return {(a, b) for a, x in rows for b, y in rows if a < b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold}


def brute_components(ids, links):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(root[a], root[b])
            if root[a] != least or root[b] != least:
                root[a] = root[b] = least
                changed = True
    return root


@pytest.mark.parametrize("cell", [2048, 8])
def test_cap_filters_find_the_links(spark, monkeypatch, cell):
    monkeypatch.setattr(cap_filters, "CELL", cell)
    rows = vectors(1, 300, copies=120) + ODD + [(9100, [1.0] * 8), (9101, [2.0] * 8), (9102, [1.0] * 8)]
    rows += [(9200 + i, rows[5][1]) for i in range(30)]
    links = brute_links(rows)
    want = brute_components([k for k, _ in rows], links)
    df = spark.createDataFrame([(*r, 1, 2) for r in [*rows, rows[0]]], VECTORS + ", kept int, label int")
    out = cap_filters.dedup_embeddings(df).collect()
    assert len(out) == len(rows) + 1
    found = {r.vec_id: r for r in out}
    n_links = {k: sum(k in pair for pair in links) for k, _ in rows}
    got = sum(r.n_links for r in found.values())
    assert got >= 0.995 * 2 * len(links) and all(found[k].n_links <= n_links[k] for k in n_links)
    assert all(found[k].component_id == want[k] for k in want if n_links[k] != 1)
    assert all(found[k].n_links == 0 and found[k].kept for k, _ in ODD)
    assert found[9100].n_links == 2 and found[9101].component_id == 9100 and found[9230 - 1].n_links >= 30
    assert cap_filters.dedup_embeddings(df.limit(0)).count() == 0


def test_equal_vectors_give_no_pair_rows(spark):
    df = spark.range(3000).selectExpr("id as vec_id", "array(1f, 2f, 0f - id % 2 * 2) as embedding")
    df = df.union(spark.createDataFrame([(7, [9.0, 9.0, 9.0])], "vec_id long, embedding array<float>"))  # of two vectors of a key, one counts
    out = cap_filters.dedup_embeddings(df).collect()
    assert {(r.n_links, r.component_id) for r in out if r.vec_id % 2 == 0} == {(1499, 0)}
    odd = {(r.n_links, r.component_id) for r in out if r.vec_id % 2 and r.vec_id != 7}
    assert odd in ({(1499, 1)}, {(1498, 1)}) and len({r for r in out if r.vec_id == 7}) == 1


def test_list_decoding_is_exhaustive():
    draw = np.random.default_rng(2)
    for blocks in (1, 2, 3):
        products = [draw.standard_normal(9) for _ in range(blocks)]
        sums = products[0]
        for p in products[1:]:
            sums = (sums[..., None] + p).reshape(*sums.shape, 9)
        for threshold in (-9.0, 0.0, 1.5, 99.0):
            assert sorted(cap_filters.list_decode(products, threshold).tolist()) == np.flatnonzero(sums.reshape(-1) >= threshold).tolist()


@pytest.mark.parametrize("count", [1_000, 20_000, 1_000_000, 30_000_000, 1_000_000_000])
def test_missed_pairs_do_not_grow_with_the_table(count):
    """Tables of every size, with other pairs than the codes are fitted on."""
    draw, dim, pairs = np.random.default_rng(8), 64, 1500
    x = draw.standard_normal((pairs, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = draw.standard_normal((pairs, dim))
    side -= np.einsum("ij,ij->i", side, x)[:, None] * x
    y = 0.9 * x + math.sqrt(1 - 0.81) * side / np.linalg.norm(side, axis=1)[:, None]
    threshold, apart = cap_filters.cap_threshold(dim, count), np.arange(pairs)
    for seed in range(cap_filters.code_count(dim, count, 0.9)):
        code, left = cap_filters.product_code(dim, seed, count), []
        for i in apart:
            (px, py) = ([p[0] for p in cap_filters.block_products(v[i : i + 1], code)] for v in (x, y))
            if not np.intersect1d(cap_filters.list_decode(px, threshold), cap_filters.list_decode(py, threshold)).size:
                left.append(i)
        apart = np.asarray(left, int)
    assert len(apart) / pairs <= 0.005


@pytest.mark.parametrize("found", [components.connected_components, components.contracted_components])
def test_components_of_paths_stars_and_loops(spark, found):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200), (None, 3), (300, None)]
    draw = np.random.default_rng(2)
    links += [(int(a), int(b)) for a, b in draw.integers(1000, 1400, (230, 2))]
    rows = found(spark.createDataFrame(links, "a long, b long")).collect()
    out = {r.id: r.component_id for r in rows}
    whole = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert len(rows) == len(out) and out == brute_components({i for pair in whole for i in pair}, whole)
    assert found(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_nearest(rows, queries, top):
    fine = [(k, np.asarray(v, np.float64)) for k, v in rows if v and all(e is not None and math.isfinite(e) for e in v) and any(v)]
    out = {}
    for q, x in fine:
        if q in queries:
            scores = []
            for k, y in fine:
                if k != q and len(x) == len(y):
                    s = 0.0
                    for a, b in zip(x, y, strict=True):
                        s += a * b
                    scores.append((-s, k))
            out[q] = [(k, -s) for s, k in sorted(scores)[:top]]
    return out


@pytest.mark.parametrize("size,recall", [(400, 1.0), (20, 0.9)])
def test_nearest_neighbours(spark, monkeypatch, size, recall):
    monkeypatch.setattr(ann, "LIST_SIZE", size)
    monkeypatch.setattr(ann, "CELL", 64)
    rows = vectors(4, 400) + [(500 + i, [1.5] * 16) for i in range(60)] + ODD + [(9100, [1.0] * 8), (9101, [2.0] * 8), (9120, [1.5] * 8), (9140, [1.0] * 3)]
    df = spark.createDataFrame([(*r, 0) for r in [*rows, rows[20]]], VECTORS + ", rank int")
    out = ann.nearest(df, "id % 20 = 0").collect()
    want = brute_nearest(rows, {k for k, _ in rows if k % 20 == 0}, 20)
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == {q for q in want if want[q]} and all(len(v) == len(want[q]) for q, v in got.items())
    assert got[9100] == want[9100] and got[9120] == want[9120] and len(got[9100]) == 2
    same = np.mean([len({k for k, _ in got[q]} & {k for k, _ in want[q]}) / len(want[q]) for q in got])
    assert same >= recall
    if recall == 1.0:
        assert got == {q: v for q, v in want.items() if v}
    few = ann.nearest(spark.createDataFrame(rows[:5], VECTORS), "id = 0").collect()
    assert len(few) == 4
    assert ann.nearest(df.limit(0), "id % 20 = 0").count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0])], VECTORS), "id = 0").count() == 0


def test_recall_holds_with_many_lists(spark, monkeypatch):
    """Vectors without structure in hundreds of lists: a fixed number of opened lists finds too few of their neighbours."""
    monkeypatch.setattr(ann, "LIST_SIZE", 20)
    draw = np.random.default_rng(7)
    x = np.float32(draw.standard_normal((12_000, 32)) * 0.125)
    df = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], VECTORS)
    got = {}
    for r in ann.nearest(df, "id % 60 = 0").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    score = x[::60].astype(float) @ x.T.astype(float)
    score[np.arange(len(score)), np.arange(0, len(x), 60)] = -np.inf
    want = np.argsort(-score, axis=1)[:, :20]
    assert np.mean([len(got[60 * i] & set(w)) / 20 for i, w in enumerate(want.tolist())]) >= 0.96


@pytest.mark.parametrize("count", [10_000, 50_000])
def test_recall_where_few_lists_open(spark, count):
    """Vectors in 300 clusters of a line's shape, with the operator's own parameters: under half of the lists are opened."""
    draw = np.random.default_rng(9)
    centre, along = draw.standard_normal((2, 300, 48))
    which = draw.integers(0, 300, count)
    x = np.float32(centre[which] + draw.standard_normal((count, 1)) * along[which] * 0.5 + draw.standard_normal((count, 48)) * 0.25)
    seen = {}

    def watched(*args):
        seen["probes"], seen["lists"] = found = plain(*args), len(args[3])
        return found[0]

    plain, ann.fitted_probes = ann.fitted_probes, watched
    try:
        df = spark.createDataFrame(__import__("pandas").DataFrame({"vec_id": np.arange(count), "embedding": list(x)}))
        rows = ann.nearest(df, "id % 400 = 0").collect()
    finally:
        ann.fitted_probes = plain
    got = {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    q = np.arange(0, count, 400)
    score = x[q].astype(float) @ x.T.astype(float)
    score[np.arange(len(q)), q] = -np.inf
    want = np.argsort(-score, axis=1)[:, :20]
    assert seen["probes"][0] < seen["lists"] / 2
    assert np.mean([len(got[int(k)] & set(w)) / 20 for k, w in zip(q, want.tolist(), strict=True)]) >= 0.9


def test_balanced_lists():
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.standard_normal((3000, 8)) * 0.3, draw.standard_normal((300, 8)) * 3])
    near = ((x[:, None] - ann.balanced_centroids(x, 16)[None]) ** 2).sum(-1).argmin(1)
    assert np.bincount(near, minlength=16).max() < 4 * len(x) / 16


def test_graph_search_finds_the_nearest_centroids():
    draw = np.random.default_rng(6)
    centroids = draw.standard_normal((300, 8))
    index = ann.Index(centroids, ann.neighbour_graph(centroids), 1.0)
    q = draw.standard_normal((50, 8))
    found, dist = index.search(q, 40)
    assert all(len(set(row)) == 40 for row in found.tolist()) and (np.diff(dist, axis=1) >= 0).all()
    exact = ((q[:, None] - centroids[None]) ** 2).sum(-1).argsort(1)[:, :10]
    assert np.mean([len(set(f) & set(e)) / 10 for f, e in zip(found.tolist(), exact.tolist(), strict=True)]) > 0.98


# --- Sharding


def test_sharding_is_stable_gapless_and_weighted(spark):
    df = spark.createDataFrame([(i, 1, "b", "f", "n") for i in range(3000)] + [(7, 1, "b", "f", "n"), (None, 2, "b", "f", "n")], "id long, slot int, _bucket string, _first string, _n string")
    out = sharding.shard_records(df, "id", [1.0, 1.0, 2.0], [1.0, 1.0, 2.0, 1.0], buckets=7).collect()
    assert len(out) == 3002 and all((r._bucket, r._first, r._n) == ("b", "f", "n") for r in out)
    for shard in range(3):
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots)))
    share = [sum(r.shard == s for r in out) / len(out) for s in range(3)]
    assert abs(share[2] - 0.5) < 0.04 and abs(share[0] - 0.25) < 0.04
    assert all(r.grown_shard in (r.shard, 3) for r in out) and 0.15 < np.mean([r.grown_shard == 3 for r in out]) < 0.25
    again = {r.id: r.shard for r in sharding.shard_records(df.repartition(3), "id", [1.0, 1.0, 2.0]).collect()}
    assert again == {r.id: r.shard for r in out}
    assert sharding.shard_records(df.limit(0), "id", [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_records(df, "id", [1.0, 0.0])


# --- URLs


URLS = ["http://a.net/x", "https://NET/", "http://net", "http://a.net?x=/", "ftp://example.net/en/1#x", "http://b.example.net/en/?q", "http://example.net/de/", "http://example.com/de/", "http://xexample.com/de/", "http://q.org/fr/z", "org/fr/", None, "", "://", "http://é.Example.COM/de/ü", "http://a.net/\nx"]


def brute_rule(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut : min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [r for r in rules if (host == r[0].split("/")[0] or host.endswith("." + r[0].split("/")[0])) and path.startswith(r[0][r[0].index("/") :])]
    rule, verdict = max(fits, key=lambda r: len(r[0]), default=(None, "allow"))
    return host, path, rule, verdict


CLASHING = ["row", "best", "_best", "r0", "v0", "k0", "_r0", "_v0", "_k0", "h", "p", "_h", "_p", "key", "block", "words", "_keys", "n", "labels", "chars"]


@pytest.mark.parametrize("most", [100_000, 0])
def test_url_rules(spark, most):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string").selectExpr("*", *[f"'{c}' as {c}" for c in CLASHING])
    extra = [(f"h{i}.example/p{i % 5}/", "block") for i in range(300)]
    for rules in (url_filter.RULES, url_filter.RULES + extra):
        listed = spark.createDataFrame([*rules, rules[0], (None, "block"), ("/nohost/", "block")], url_filter.LISTED)
        out = url_filter.filter_urls(df, listed, max_broadcast=most).collect()
        assert len(out) == len(URLS) + 3 and all(r[c] == c for r in out for c in CLASHING)
        for r in out:
            assert (r.host, r.path, r.rule, r.verdict) == brute_rule(r.url, rules)
    none = url_filter.filter_urls(df, spark.createDataFrame([], url_filter.LISTED)).collect()
    assert all(r.rule is None and r.verdict == "allow" for r in none)
    assert url_filter.filter_urls(df.limit(0), listed).count() == 0


@pytest.mark.parametrize("entries,most", [(2000, 250_000), (2000, 0), (1_000_000, 250_000)])
def test_bloom_filter_holds_all_keys_and_few_others(spark, monkeypatch, entries, most):
    from pyspark.sql import functions as F

    monkeypatch.setattr(url_filter, "MAX_BROADCAST_BLOCKS", most)
    name = lambda i: F.concat(F.lit("h"), i.cast("string"), F.lit(".example/"))
    rules = url_filter.canonical_list(spark.range(entries).select(name(F.col("id")).alias("rule"), F.lit("block").alias("verdict")))
    keys = spark.range(entries - 1000, entries + 20_000).select(name(F.col("id")).alias("key"), "id")
    hits = {r.id for r in url_filter.passing(keys, rules, -(-entries // url_filter.KEYS_PER_BLOCK)).collect()}
    assert set(range(entries - 1000, entries)) <= hits and len(hits) < 1000 + 200
