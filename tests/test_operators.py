"""Trees, versions, chains, restores, ordering on small cases."""

import itertools

import pytest
from pyspark.sql import functions as F

from vaultline.operators import chunks, ordering, restore, tree, versions
from vaultline.sources.restore import progress_rows


def dirs(spark, rows):
    return spark.createDataFrame(rows, "id string, parent string, name string")


def test_deep_trees_cycles_and_orphans(spark):
    deep = [(f"d{i}", f"d{i - 1}" if i else None, f"n{i}") for i in range(40)]
    odd = [("x", "y", "x"), ("y", "x", "y"), ("z", "missing", "z"), ("s", "d0", "@eaDir"), ("t", "s", "under")]
    got = {r.id: r for r in tree.directories(dirs(spark, deep + odd)).collect()}
    assert got["d39"].path == "/" + "/".join(f"n{i}" for i in range(40)) and got["d39"].ancestors[0] == "d0"
    assert set(got) == {d[0] for d in deep} | {"s", "t", "z"} and got["t"].pruned and not got["d1"].pruned
    assert got["z"].path == "/z" and got["z"].ancestors == ["z"]
    under = {r.id: r.path for r in tree.directories(dirs(spark, deep + odd + [("self", "self", "own")]), root="d0").collect()}
    assert under["z"] == "/n0/z" and under["self"] == "/n0/own" and "x" not in under and under["d2"] == "/n0/n1/n2"


def test_totals_are_sums_of_children(spark):
    d = dirs(spark, [("r", None, "r"), ("a", "r", "a"), ("b", "a", "b"), ("e", "r", "empty"), ("k", "r", "@eaDir")])
    files = spark.createDataFrame([("b", "1", 5), ("a", "2", 7), ("k", "3", 100), ("b", "4", None), ("b", "x@SynoResource", 9)], "parent string, name string, size long")
    got = {r.id: (r.size, r.nfiles) for r in tree.subtree_totals(d, files).collect()}
    assert got == {"r": (12, 3), "a": (12, 3), "b": (5, 2), "e": (0, 0)}
    assert sorted(r.path for r in tree.file_paths(d, files).collect()) == ["/r/a/2", "/r/a/b/1", "/r/a/b/4"]


def test_orphans_count_under_the_share_root(spark):
    d = dirs(spark, [("r", None, "r"), ("a", "gone", "a"), ("b", "a", "b")])
    files = spark.createDataFrame([("b", "1", 5), ("gone", "2", 7), ("r", "3", 1)], "parent string, name string, size long")
    got = {r.id: (r.path, r.size, r.nfiles) for r in tree.subtree_totals(d, files, root="r").collect()}
    assert got == {"r": ("/r", 13, 3), "a": ("/r/a", 5, 1), "b": ("/r/a/b", 5, 1)}
    assert sorted(r.path for r in tree.file_paths(d, files, root="r").collect()) == ["/r/2", "/r/3", "/r/a/b/1"]
    loose = {r.id: (r.path, r.size) for r in tree.subtree_totals(d, files).collect()}
    assert loose == {"r": ("/r", 1), "a": ("/a", 5), "b": ("/a/b", 5)}


@pytest.mark.parametrize("shape", ["line", "fork"])
def test_trees_of_any_depth_are_whole(spark, shape):
    n = 300 if shape == "line" else 64
    rows = [(f"d{i}", f"d{i - 1 if shape == 'line' else (i - 1) // 2}" if i else None, "x") for i in range(n)]
    got = {r.id: len(r.ancestors) for r in tree.directories(dirs(spark, rows)).collect()}
    assert len(got) == n and got[f"d{n - 1}"] == (n if shape == "line" else 7)


def test_select_all_and_none(spark):
    d = dirs(spark, [("r", None, "r"), ("a", "r", "a"), ("s", None, "s"), ("o", "gone", "o"), ("q", "q", "q")])
    assert sorted(r.id for r in tree.select_all(d).collect()) == ["o", "q", "r", "s"] and tree.select_none(d).collect() == []


def test_selection(spark):
    d = dirs(spark, [("r", None, "r"), ("a", "r", "a"), ("b", "r", "b"), ("c", "a", "c"), ("d", "a", "d")])
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    names = lambda df: sorted(r.id for r in df.collect())
    assert names(tree.toggle_off(d, ids("r"), "c")) == ["b", "d"]
    assert names(tree.toggle_off(d, ids("b"), "c")) == ["b"]
    assert names(tree.toggle_on(d, ids("c", "b"), "a")) == ["a", "b"]
    assert names(tree.toggle_on(d, ids("r"), "c")) == ["r"]
    state = {r.id: r.state for r in tree.selection_state(d, ids("a")).collect()}
    assert state == {"r": "PARTIAL", "a": "FULL", "b": "NONE", "c": "FULL", "d": "FULL"}


#: 2023-11-16 02:00:00 UTC; backups follow every seven hours.
FIRST, EVERY = 1_700_100_000, 25_200


def backups(spark, statuses, stamps=True):
    rows = [(i + 1, FIRST + i * EVERY if stamps else None, s) for i, s in enumerate(statuses)]
    return spark.createDataFrame(rows, "id long, timestamp long, status string")


RESOLVED = {
    None: 2, "2": 2, "1": 1, "@2023-11-16": 2, "@2023-11-16 02:00": 1, "@2023-11-16T08:59": 1, "@2023-11-16 08:59:59": 1,
    "@2023-11-16 09:00:00": 2, "@2041-05-06": 2,
}


@pytest.mark.parametrize("spec", RESOLVED)
def test_resolve(spark, spec):
    assert versions.resolve(backups(spark, ["Complete", "Complete", "Backingup"]), None, spec) == RESOLVED[spec]


@pytest.mark.parametrize("spec", ["+3", "latest", "@yesterday", "@2023-06-31", "2e1", "٣"])
def test_malformed(spark, spec):
    with pytest.raises(versions.InvalidVersionSpec):
        versions.resolve(backups(spark, ["Complete"]), None, spec)


def test_not_found(spark):
    v = backups(spark, ["Complete", "Failure", "Complete"])
    have = spark.createDataFrame([(1,), (3,)], "id long")
    for spec, words in (("17", "no version 17"), ("0", "no version 0"), ("2", "the backup failed"), ("@1999-12-31", "at or before")):
        with pytest.raises(versions.VersionNotFound, match=words):
            versions.resolve(v, have, spec)
    with pytest.raises(versions.VersionNotFound, match="incomplete"):
        versions.resolve(v, None, "2")
    with pytest.raises(versions.VersionNotFound, match="no version dates"):
        versions.resolve(backups(spark, [None], stamps=False), None, "@2023-11-20")
    with pytest.raises(versions.VersionNotFound, match="no usable"):
        versions.resolve(backups(spark, ["Failure"]), None, None)
    assert versions.resolve(v, None, "2", allow_incomplete=True) == 2
    assert versions.resolve(backups(spark, [None, None]), None, None) == 2  # unknown counts as usable


def test_as_of_equals_brute_force(spark):
    rows = [(i, (i * 7919) % 500, "Complete") for i in range(80)]
    v = spark.createDataFrame(rows, "id long, timestamp long, status string")
    cuts = spark.createDataFrame([(c,) for c in range(-5, 510, 3)], "cutoff long")
    for r in versions.latest_as_of(cuts, v, width=37).collect():
        assert r.id == max(((t, i) for i, t, _ in rows if t <= r.cutoff), default=(None, None))[1]


def test_chains(spark):
    rows = [(0, None), *[(i, i - 1) for i in range(1, 30)], (50, 51), (51, 50), (60, 60), (70, 999)]
    got = {r.key: (r.target, r.hops, r.error) for r in chunks.follow(spark.createDataFrame(rows, "key long, cite long")).collect()}
    for i in range(30):
        assert got[i] == ((0, i, None) if i <= 16 else (None, None, "cite loop"))
    assert got[50][2] == got[60][2] == "cite loop" and got[70][2] == "missing"


def test_resume_table(spark):
    rows = [(10, None, True, 1, True), (10, 9, True, 1, True), (10, 10, False, None, False), (10, 10, True, 2, True), (10, 10, True, None, True), (10, 10, True, 1, True), (10, 10, True, 1, False)]
    frame = spark.createDataFrame(rows, "size long, have long, recorded boolean, rec long, same boolean")
    take = lambda strict: [r.x for r in frame.coalesce(1).select(restore.decision(F.col("size"), F.col("have"), F.lit(1), F.col("recorded"), F.col("rec"), F.col("same"), strict).alias("x")).collect()]
    assert take(False) == ["extract", "extract", "skip", "extract", "extract", "skip", "skip"]
    assert take(True) == ["extract", "extract", "extract", "extract", "extract", "skip", "extract"]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 100])
def test_blocks_and_numbers(spark, n):
    frame = spark.range(n).select(((F.col("id") * 37) % 101).alias("ovf"))
    rows = sorted((r.ovf, r.worker, r.rn) for r in ordering.worker_blocks(frame, 8, "ovf").collect())
    per = -(-n // max(1, min(8, n))) if n else 1
    assert [r[2] for r in rows] == list(range(1, n + 1)) and [r[1] for r in rows] == [i // per for i in range(n)]


def test_slices(spark):
    for n, k in itertools.product((1, 5, 20, 23), (1, 7, 20)):
        frame = spark.range(n).select(F.lit("s").alias("share"), F.col("id").alias("ovf"))
        k_ = min(k, n)
        expected = [(i * n // k_ + ((i + 1) * n // k_ - i * n // k_) // 2) for i in range(k_)]
        assert sorted(r.ovf for r in ordering.slice_sample(frame, "share", ["ovf"], k).collect()) == expected
        some = sorted(r.ovf for r in ordering.slice_sample(frame, "share", ["ovf"], k, seed=3).collect())
        assert len(some) == k_ and all(i * n // k_ <= x < (i + 1) * n // k_ for i, x in enumerate(some))


def test_runs(spark):
    bad = [0, 1, 1, 0, 1, 0, 0, 1, 1, 1]
    frame = spark.createDataFrame([(1, i, bool(b)) for i, b in enumerate(bad)], "g int, i int, bad boolean")
    assert sorted((r.start, r.length) for r in ordering.run_lengths(frame, ["g"], ["i"], "bad").collect()) == [(1, 2), (4, 1), (7, 3)]


def test_progress_in_batches(spark):
    sizes = {"a": [3, 3, 3, 3, 1], "b": [20], "c": [], "d": [1, 9, 10]}
    rows = [(p, i, n) for p, x in sizes.items() for i, n in enumerate(x)]
    got = progress_rows(spark.createDataFrame(rows, "path string, seq long, length long").repartition(3), step=10).collect()
    assert sorted((r.p, r.k, r.b) for r in got) == sorted([("a", "P", 12), ("a", "P", 1), ("b", "P", 20), ("d", "P", 10), ("d", "P", 10), *[(p, "O", 0) for p in "abd"]])


def test_error_report(spark):
    errors = spark.createDataFrame([(i, f"e{i}") for i in range(5)], "i int, m string")
    lines = lambda n: [r.line for r in restore.error_report(errors, ["i"], F.col("m"), n).orderBy("rn").collect()]
    assert lines(3) == ["  failed: e0", "  failed: e1", "  failed: e2", "  and 2 more"] and len(lines(5)) == 5 and lines(9)[-1] == "  failed: e4"
