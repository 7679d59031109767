"""Top-k search (1), URL filters (9), fingerprints (3)."""

import hashlib

import numpy as np
import pytest
from brute import slow_likeness, slow_sketch
from pyspark.sql import functions as F

from vaultline.llm import fingerprint as fp
from vaultline.llm import topk, urls


LIMITS = [{}, {"rows_per_block": 7, "queries_per_batch": 3, "sample": 30, "pivots": 4}, {"sample": 2, "pivots": 1}]


@pytest.mark.parametrize("limits", LIMITS)
def test_top_k_equals_brute_force(spark, limits):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 0.3, (90, 17)).astype(np.float32)
    v[40:60] = v[10]  # ties
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)]
    rows += [(200, None, 0), (201, [1.0, None], 0), (202, [float("nan")] * 17, 0), (203, [float("inf")] * 17, 0), (None, [1.0] * 17, 0), (220, [], 0)]
    rows += [(5, [float(x) for x in v[7]], 1), (20, [float(x) for x in v[8]], 1), (20, [float(x) for x in v[20]], 1)]  # ids that repeat
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int")
    got = [tuple(r) for r in topk.top_k(topk.quantised(table), F.col("vec_id") % 20 == 0, 5, **limits).collect()]
    kept = [(i, np.floor(64 * np.array(x)).astype(np.int64) if len(x) else np.zeros(17, np.int64)) for i, x, _ in rows if i is not None and x is not None and all(e is not None and np.isfinite(e) for e in x)]
    want = []
    for a, (i, x) in enumerate(kept):
        if i % 20 == 0:
            best = sorted((-int(x @ y), j) for b, (j, y) in enumerate(kept) if a != b)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(got) == sorted(want) and len(got) == 5 * 8


def test_all_rows_of_an_id_are_candidates(spark):
    made = spark.createDataFrame([(20, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [5.0, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(topk.quantised(made), F.col("vec_id") == 20).collect()]
    assert sorted(got) == [(20, 1, 1, 64 * 64 * 6), (20, 2, 1, 64 * 64 * 2)]


def test_top_k_large_scores_are_exact(spark):
    big = [[2.0**25 + 1, 3.0], [2.0**20 + 1, 2.0**27], [-(2.0**20), 7.0]]
    made = topk.quantised(spark.createDataFrame([(20 * i, x) for i, x in enumerate(big)], "vec_id long, embedding array<double>"))
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(made, F.lit(True)).collect()}
    for i, x in enumerate(big):
        for j, y in enumerate(big):
            if i != j:
                assert got[20 * i, 20 * j] == sum(int(64 * a) * int(64 * b) for a, b in zip(x, y, strict=True))


def test_few_pairs_of_clustered_vectors_are_scored():
    """Twenty clusters: under a tenth of all pairs reaches the exact scores, and blocks of other clusters are left out."""
    rng = np.random.default_rng(12)
    centers = rng.normal(0, 40, (20, 64))
    x = np.floor(np.repeat(centers, 150, axis=0) + rng.normal(0, 4, (3000, 64))).astype(np.int64)
    block = topk.Block(np.arange(3000), np.arange(3000), x)
    q, own = x[::10], np.arange(0, 3000, 10)
    floor = np.partition(q @ x[::7].T, -10, axis=1)[:, -10]  # as from a sample
    rows, ids, scores = block.top_k(own, q, floor, 10)
    exact = q @ x.T
    exact[np.arange(300), own] = np.iinfo(np.int64).min
    for i in range(300):
        want = sorted((-int(s), j) for j, s in enumerate(exact[i]))[:10]
        assert [(-int(s), int(j)) for s, j in zip(scores[rows == i], ids[rows == i], strict=True)] == want
    assert block.scored < 0.1 * exact.size
    ranges = np.array([topk._ranges(topk._statistics(x[a : a + 150].astype(float), 16)) for a in range(0, 3000, 150)])
    bounds = topk.block_bounds(topk._statistics(q.astype(float), 16), ranges)
    assert (bounds + 1e-6 >= np.maximum.reduceat(q @ x.T, np.arange(0, 3000, 150), axis=1)).all()
    assert (bounds >= floor[:, None]).mean() < 0.3


def test_bounds_hold():
    rng = np.random.default_rng(0)
    q, x = rng.normal(size=(20, 23)), rng.normal(size=(30, 23))
    before = None
    for n in topk.LEVELS:
        bound = topk._statistics(q, n) @ topk._statistics(x, n).T
        assert (bound >= q @ x.T - 1e-9).all()
        assert before is None or bound.mean() <= before
        before = bound.mean()


def test_empty_vectors(spark):
    made = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(made, F.lit(True)).collect() == []


URLS = {
    "http://A.Example.NET/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
    "https://x.net/": ("x.net", "/", "net/", "block"),
    "https://x.net": ("x.net", "", None, "block"),  # the rule's path is /; the host is a blocked seed
    "http://example.com/de/2?q=/en/": ("example.com", "/de/2", "example.com/de/", "block"),
    "http://notexample.com/de/2": ("notexample.com", "/de/2", None, "allow"),
    "http://a.org/fr/#x": ("a.org", "/fr/", "org/fr/", "allow"),
    "no scheme": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "http://h?u=http://x.net/": ("h", "", None, "allow"),
    "a://b://c/d": ("b:", "//c/d", None, "allow"),
    "://ÄB.org/fr/": ("Äb.org", "/fr/", "org/fr/", "allow"),
}


def test_rules(spark):
    rows = [(i, u, None, "own") for i, u in enumerate(URLS)] * 2
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == list(URLS.values())[r.page_id]


def test_propagation(spark):
    links = lambda *hosts: "".join(f'<a HREF="http://{h}/x">y</a>' for h in hosts)
    pages = [
        (0, "http://good.org/fr/", links("near.info", "near.info")),
        (1, "http://near.info/", links("far.info")),
        (2, "http://far.info/", None),
        (3, "http://shady.info/", links("bad.net")),
        (4, "http://bad.net/", ""),
        (5, "http://worse.info/", links("shady.info")),
        (6, "http://alone.info/", '<a href="/local">'),
    ]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[i].verdict for i in range(7)] == ["allow", "allow", "allow", "block", "block", "block", "allow"]
    assert got[1].trust > got[2].trust > 0 and got[3].distrust > got[5].distrust > 0 and got[6].trust == got[6].distrust == 0
    assert sum({r.host: r.trust for r in got.values()}.values()) <= 1 + 1e-6
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_equal_substrings_share_names():
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    body = word(3000)
    a, b, other = fp.sketches([body, word(37) + body + word(11), word(3000)])
    assert fp.likeness(a, b) > 0.9 and fp.likeness(a, other) < 0.2 and fp.likeness(a, a) == 1


@pytest.mark.parametrize("batch", [40, 600_000])
def test_fingerprints(docs, monkeypatch, batch):
    texts = ["", "a", None, "aaaaaaaaaaaa", "the same text here", "the same text here", "ünï🙂çødé " * 40, "long " * 20_000 + "end", "b"]
    ids = [5, 3, 9, 1, 7, 7, 100, 50, None]
    monkeypatch.setattr(fp, "CHARS", batch)
    made = docs(texts, ids)
    hashed = {r.text: r.h for r in made.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, hashed[texts[i] or ""]))
    rows = fp.fingerprint(made).collect()
    assert len(rows) == len(texts)
    expected = []
    for k, i in enumerate(order):
        t, follow = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        e = fp.edited(t, follow)
        own, other, after = slow_sketch(t), slow_sketch(e), slow_sketch(follow)
        digits = lambda x: "".join(f"{v:08x}" for v in x)
        expected.append((ids[i], len(t), hashlib.sha256(e.encode()).hexdigest(), digits(own), digits(other), slow_likeness(own, other), slow_likeness(own, after)))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, rows), key=key) == sorted(expected, key=key)
    assert fp.fingerprint(docs(["x"]).where("false")).collect() == []
    assert [r.near_next for r in fp.fingerprint(docs(["only one"])).collect()] == [1.0]


def test_sketches_equal_symbol_by_symbol():
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list(letters), int(rng.integers(1, n)))) for letters in ("ab", "abcdefg é", "xyz🙂日") for n in (3, 12, 60, 900) for _ in range(6)]
    for t, s in zip(texts, fp.sketches(texts), strict=True):
        assert s.tolist() == slow_sketch(t)


def test_edits_are_liker_than_the_next_document(spark):
    rows = fp.fingerprint(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).where("n_chars >= 40").collect()
    assert sum(r.near_edited > r.near_next or r.near_next == 1 for r in rows) >= 0.98 * len(rows)


def test_ids_that_many_rows_share_are_spread(docs):
    """Two hundred texts under one id and two hundred without: several buckets, and every row has its follower."""
    texts = [f"text number {i} " * 3 for i in range(400)]
    made = docs(texts, [7] * 200 + [None] * 200)
    placed = fp.in_order(made, 16).where("tail = 0").groupBy("bucket").count().collect()
    assert len(placed) >= 12 and max(r["count"] for r in placed) < 80
    assert len(fp.fingerprint(made).collect()) == 400
    assert fp._bounds([1, 4, 4, 9]) == [(1, -(2**63)), (4, -(2**63)), (4, 0), (9, -(2**63))]


def test_propagation_equals_dense_pagerank(spark):
    """Random links between 40 hosts, against the solution of the linear equations."""
    rng = np.random.default_rng(4)
    links = [(int(a), int(b), int(n)) for a, b, n in zip(rng.integers(0, 40, 150), rng.integers(0, 40, 150), rng.integers(1, 5, 150), strict=True) if a != b]
    w = np.zeros((40, 40))
    for a, b, n in links:
        w[a, b] += n
    edges = spark.createDataFrame([("trust", f"h{a}", f"h{b}", n) for a, b, n in links], "kind string, src string, dst string, n long")
    seeds = [3, 8, 21]
    got = {r.host: r.score for r in urls.propagate(edges, spark.createDataFrame([("trust", f"h{i}") for i in seeds], "kind string, host string")).collect()}
    out = w.sum(axis=1, keepdims=True)
    step = np.divide(w, out, out=np.zeros_like(w), where=out > 0)
    exact = np.linalg.solve(np.eye(40) - 0.85 * step.T, 0.15 * np.isin(np.arange(40), seeds))
    assert all(abs(got.get(f"h{i}", 0) - exact[i]) < 1e-5 for i in range(40)) and (exact > 0.001).sum() > 20


def test_verdicts_with_twenty_thousand_seeds(spark):
    """A blocked host's own pages, and those of a host that links to it, are blocked however many hosts are; a tie is allowed."""
    link = lambda *hosts: "".join(f'<a href="http://{h}/">y</a>' for h in hosts)
    pages = [(0, "http://h5.net", None), (1, "http://shady.info/", link("h6.net")), (2, "http://both.info/", link("h7.net")), (3, "http://ok.org/fr/", link("both.info", "both.info"))]
    pages += [(10 + i, f"http://h{i}.net/", None) for i in range(20_000)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).where("page_id < 4").collect()}
    assert [got[i].verdict for i in range(4)] == ["block", "block", "allow", "allow"] and got[2].trust == got[2].distrust > 0


def test_verdicts_do_not_depend_on_unrelated_hosts(spark):
    """A small graph has the same verdicts and scores alone and beside 5,000 blocked hosts that it has no links with."""
    link = '<a href="http://{}/">y</a>'
    pages = [(0, "http://bad.net/", None), (1, "http://shady.info/", link.format("bad.net")), (2, "http://worse.info/", link.format("shady.info"))]
    more = [(10 + i, f"http://h{i}.net/", None) for i in range(5000)]
    judged = lambda rows: {
        r.page_id: (r.verdict, r.distrust)
        for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).where("page_id < 10").collect()
    }
    alone = judged(pages)
    assert alone == judged(pages + more) and {v for v, _ in alone.values()} == {"block"}


def test_propagation_ends_by_tolerance_or_raises(spark):
    edges = spark.createDataFrame([("trust", "a", "b", 1), ("trust", "b", "a", 1)], "kind string, src string, dst string, n long")
    seeds = spark.createDataFrame([("trust", "a")], "kind string, host string")
    got = {r.host: r.score for r in urls.propagate(edges, seeds, damping=0.5).collect()}
    assert abs(got["a"] - 2 / 3) < 1e-5 and abs(got["b"] - 1 / 3) < 1e-5
    with pytest.raises(RuntimeError):
        urls.propagate(edges, seeds, rounds=3)


def test_only_small_hashes_are_sorted(monkeypatch):
    """Sketches hold the smallest of all hashes, also where names repeat, and long texts have few of theirs sorted."""
    rng = np.random.default_rng(5)
    texts = ["", "a", "ab" * 3000, "the same words again " * 900, "".join(map(chr, rng.integers(97, 123, 40_000))), "xyz" * 7 + "".join(map(chr, rng.integers(97, 123, 300)))]
    keys = np.concatenate([(np.uint64(i) << np.uint64(32)) | rng.integers(0, top, n).astype(np.uint64) for i, n, top in ((0, 5, 2**32), (2, 9000, 2**32), (3, 9000, 50), (5, 300, 2**32))])
    got, every = fp._smallest(keys.copy(), 7), np.unique(keys)
    for i in range(7):
        mine, all_ = (k[k >> np.uint64(32) == np.uint64(i)][: fp.SIZE] for k in (got, every))
        assert mine.tolist() == all_.tolist()
    expected = [s.tolist() for s in (fp.sketches([t])[0] for t in texts)]
    assert [s.tolist() for s in fp.sketches(texts)] == expected
    assert expected == [slow_sketch(t) for t in texts]
    seen, distinct = [], fp._distinct
    monkeypatch.setattr(fp, "_distinct", lambda k: seen.append(len(k)) or distinct(k))
    fp.sketches([texts[4]])
    assert sum(seen) < 600
