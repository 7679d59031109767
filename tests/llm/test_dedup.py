"""Line dedup (5), repeated strings (7), SimHash (10), components."""

import numpy as np
import pytest
from brute import brute_lines, brute_repeats, slow_fingerprint

from vaultline.llm import lines, simhash, suffixes
from vaultline.llm.components import connected_components
from vaultline.llm.simhash import near_copies


def line_texts():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    base = [list(rng.choice(words, n)) for n in (3, 5, 9, 10, 11, 14, 40)]
    out = []
    for _ in range(60):
        rows = []
        for _ in range(int(rng.integers(0, 6))):
            w = list(base[int(rng.integers(len(base)))])
            for _ in range(int(rng.integers(0, 3))):
                k = int(rng.integers(len(w)))
                w = [w[:k] + w[k + 1 :], w[:k] + ["new"] + w[k:], w[:k] + ["other"] + w[k + 1 :]][int(rng.integers(3))]
            rows.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
        out.append("\n".join(rows))
    return [*out, None, "", "\n\n", "a b c d e f g h i j k l " * 3000]


def test_lines_equal_brute_force(docs):
    texts = line_texts()
    gone = brute_lines(texts)
    rows = lines.without_duplicates(docs(texts)).collect()
    assert len(rows) == len(texts) and sum(map(len, gone.values())) > 50
    for r in rows:
        t = texts[r.doc_id]
        assert r.removed_lines == gone.get(r.doc_id, [])
        assert r.n_lines == (0 if t is None else t.count("\n") + 1)
        assert r.text == (None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone.get(r.doc_id, [])))


def test_variant_hashes():
    words = [f"w{i % 3}" for i in range(7)]
    h = lines.variant_hashes(words)
    assert len(h) == 8
    for i in range(7):
        assert h[i + 1] == lines.variant_hashes(words[:i] + words[i + 1 :])[0]
    assert len(set(lines.variant_hashes([f"x{i}" for i in range(50_000)]).tolist())) == 50_001


def test_lines_stage(docs):
    copy = "one two three four five six seven eight nine ten"
    made = docs([copy + "\nshort", copy, "", None, copy.replace("five", "fünf"), "some line that no other row has"], ids=[4, 5, 6, 7, None, None])
    rows = {r.doc_id: r for r in lines.keep_new_lines(made).collect()}
    assert sorted(rows, key=str) == [4, 6, 7, None] and rows[4].text.startswith("one") and rows[None].doc == 7
    assert rows[None].text == "some line that no other row has"
    assert lines.keep_new_lines(made).columns == made.columns
    assert lines.keep_new_lines(made.where("false")).collect() == []


def test_repeated_rows_are_one_document_for_lines(docs):
    t = "one two three four five six seven"
    assert [r.text for r in lines.without_duplicates(docs([t, t], ids=[3, 3])).collect()] == [t, t]


def test_lines_under_shared_ids(docs):
    """A row never loses what it alone has, whatever rows it shares its id with."""
    t = "one two three four five six seven"
    texts = [t, t + "\nwords that stand in no other row", "words standing in this row only\n" + t, "null row has words of its own", t]
    rows = lines.without_duplicates(docs(texts, ids=[1, 2, 2, None, None])).collect()
    assert sorted((str(r.doc_id), r.text) for r in rows) == sorted(
        [("1", t), ("2", "words that stand in no other row"), ("2", "words standing in this row only"), ("None", texts[3]), ("None", "")])


def test_line_lengths_are_parameters(docs):
    rows = lines.without_duplicates(docs(["a b", "a b", "a c"]), min_words=1, near_words=2).collect()
    assert {r.doc_id: r.text for r in rows} == {0: "a b", 1: "", 2: ""}


def repeat_texts():
    rng = np.random.default_rng(1)
    word = lambda letters, n: "".join(rng.choice(list(letters), n))
    base = [word("abcdefg é", 700) for _ in range(4)]
    out = []
    for k in range(40):
        a = int(rng.integers(0, 350))
        out.append(word("xyz", int(rng.integers(0, 90))) + base[k % 4][a : a + int(rng.integers(150, 350))] + word("pqr", int(rng.integers(0, 90))))
    return [*out, "a" * 450, "ab" * 300, "", None, "x" * 199, "y" * 200, "y" * 200, base[0], base[0], base[1][:199], word("klmno", 30_000)]


@pytest.mark.parametrize("most", [16_000_000, 900])
def test_repeats_equal_brute_force(docs, monkeypatch, most):
    texts = repeat_texts()
    whole = suffixes.covered
    monkeypatch.setattr(suffixes, "covered", lambda d: whole(d, most))
    rows = {r.doc_id: tuple(r)[1:] for r in suffixes.measure(docs(texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == brute_repeats(texts)


def test_repeats_in_repeated_rows_and_without_ids(docs):
    rng = np.random.default_rng(8)
    t, u = ("".join(rng.choice(list("abcdefgh"), 300)) for _ in range(2))
    made = docs([t, t, u, None], ids=[1, 1, None, None])
    assert sorted((r.doc_id, r.n_removed) for r in suffixes.measure(made).where("n_bytes > 0").collect() if r.doc_id) == [(1, 300), (1, 300)]
    rows = suffixes.without_repeats(made)
    assert rows.columns == made.columns and sorted(map(str, (r.text for r in rows.collect()))) == sorted(["", "", u, "None"])
    assert suffixes.measure(made.where("false")).collect() == []


def test_repeats_under_shared_ids(docs):
    """Rows that share an id, or have none, lose what they have in common with others and nothing else."""
    texts = repeat_texts()
    for ids in ([i // 3 for i in range(len(texts))], [None] * len(texts), [7] * len(texts)):
        expected = sorted(zip(map(str, ids), brute_repeats(texts), strict=True))
        assert sorted((str(r[0]), tuple(r)[1:]) for r in suffixes.measure(docs(texts, ids=ids)).collect()) == expected


def test_fingerprint():
    for t in ["", None, "One two", "A b c D", "é À ß ſ x", "a  b\tc\nd e\u00a0f g", "w " * 3000, " \n "]:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_golay_keys():
    """Any two words at distance 2 or less have a key in common; by linearity the words near one codeword stand for all."""
    from itertools import combinations

    errors = [sum(1 << i for i in c) for n in range(4) for c in combinations(range(23), n)]
    sample = np.array(errors[:: max(1, len(errors) // 250)], np.int64)
    flips = [0, *[1 << i for i in range(23)], *[(1 << i) | (1 << j) for i, j in combinations(range(23), 2)]]
    own = [set(k) for k in simhash.segment_keys(sample).tolist()]
    for f in flips:
        for a, b in zip(own, simhash.segment_keys(sample ^ f).tolist(), strict=True):
            assert a & set(b)
    assert max(map(len, own)) == 6


@pytest.mark.parametrize("limits", [{}, {"few": 2, "most": 6, "sample": 1}, {"few": 3, "most": 60, "sample": 2}])
def test_links_connect_what_radius_connects(spark, limits):
    rng = np.random.default_rng(1)
    found = set()
    for center in rng.integers(0, 2**63, 15).tolist():
        for _ in range(50):
            x = center
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            found.add(x)
    f = np.array(sorted(found), np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 4
    label = np.arange(len(f))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(f))])
        if (new == label).all():
            break
        label = new
    signed = f.view(np.int64).tolist()
    comp = connected_components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, **limits))
    got = {r.node: r.component for r in comp.collect()}
    groups = {}
    for i, x in enumerate(signed):
        groups.setdefault(int(label[i]), set()).add(got.get(x, x))
    assert all(len(v) == 1 for v in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_groups_and_stage(docs):
    text = " ".join(f"w{i}" for i in range(300))
    texts = [text, text + " more", "", None, "  ", "other words altogether here now", text, "other words altogether here now"]
    ids = [7, 3, 5, 4, None, 9, 3, 12]
    rows = simhash.groups(docs(texts, ids)).collect()
    fps = [slow_fingerprint(t) for t in texts]
    assert len(rows) == len(texts)
    for r in rows:
        mine = [i for i in range(len(ids)) if ids[i] == r.doc_id][0]
        linked = [ids[i] for i in range(len(ids)) if (fps[i] ^ fps[mine]).bit_count() <= 4 and ids[i] is not None]
        assert r.component_id == min(linked)
    kept = simhash.keep_one(docs(texts, ids)).collect()
    assert sorted(r.doc_id for r in kept) == [3, 4, 9] and len(kept) == 3
    assert next(r.text for r in kept if r.doc_id == 3) == min(text, text + " more")
    assert simhash.groups(docs(["x"]).where("false")).collect() == []


def test_stage_tells_rows_apart_without_ids(docs):
    """Unrelated rows without an id, or with the same one, all stay; of a group with an id, no row without one does."""
    unlike = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdefg"]
    texts = [*unlike[:4], unlike[0], unlike[4], unlike[4], unlike[5], unlike[6]]
    ids = [None, None, None, None, None, 2, None, 5, 5]
    kept = sorted((r.text, r.doc_id) for r in simhash.keep_one(docs(texts, ids)).collect())
    assert kept == [*((t, None) for t in unlike[:4]), (unlike[4], 2), (unlike[5], 5), (unlike[6], 5)]


def jaccard_texts():
    """Texts of 40 to 300 words and copies of them with some words changed, so that likeness is 0.5 to 1."""
    rng = np.random.default_rng(5)
    out = []
    for k in range(30):
        base = [f"w{i}" for i in rng.integers(0, 5000, int(rng.integers(40, 300)))]
        out.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for at in rng.choice(len(copy), int(rng.integers(0, max(2, len(copy) // 18))), replace=False):
                copy[at] = f"new{rng.integers(0, 10**6)}"
            out.append(" ".join(copy).title() if k % 3 == 0 else "  ".join(copy))
    return [*out, "a b c", "A  b c", "a b", None, "", " "]


def test_stage_keeps_what_brute_force_jaccard_keeps(docs):
    texts = jaccard_texts()
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    like = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    label = list(range(len(texts)))
    pairs = [(i, j) for i in label for j in range(i) if like(sets[i], sets[j])]
    near = sum(len(sets[i] & sets[j]) < 0.9 * len(sets[i] | sets[j]) for i, j in pairs)
    for _ in label:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    kept = {r.doc_id for r in simhash.keep_one(docs(texts)).collect()}
    gone = len(texts) - len(set(label))
    # whatever goes has a partner that stays, and of what should go 97 % does
    assert near > 20 and gone > 40 and all(any(label[k] == label[i] for k in kept) for i in range(len(texts)) if i not in kept)
    assert set(label) <= kept and len(kept) - len(set(label)) <= 0.03 * gone


@pytest.mark.parametrize("limits", [{}, {"few": 1}, {"few": 1, "most": 4}])
def test_near_copies_connect_chains(docs, limits):
    """Neighbours of a chain are alike, its ends aren't: one component, by small buckets, large ones, and large ones in blocks."""
    text = lambda k: " ".join(f"w{i}" for i in range(k * 6, k * 6 + 120))
    rows = docs([text(k) for k in range(12)] + ["x " * 50]).withColumnRenamed("doc_id", "row").select("row", "text")
    got = {r.row: r.component for r in near_copies(rows, **limits).collect()}
    assert len({got[k] for k in range(12)}) == 1 and len(set(got.values())) == 2


@pytest.mark.parametrize("limits", [{}, {"few": 1, "most": 16}])
def test_large_groups_with_outliers(docs, limits):
    """Copies of one text with ever more changes: some are alike to few others and some to none; all links are found, others aren't made."""
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for at in rng.choice(150, int(rng.integers(0, 9)), replace=False):
            copy[at] = f"new{rng.integers(0, 10**6)}"
        texts.append(" ".join(copy))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    pairs = [(i, j) for i in label for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in label:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    rows = docs(texts).withColumnRenamed("doc_id", "row").select("row", "text")
    got = {r.row: r.component for r in near_copies(rows, **limits).collect()}
    assert len({got[i] for i in got if label[i] == label[0]}) == 1 and len(set(got.values())) == len(set(label)) > 3


def test_wide_keys_find_likeness_of_four_fifths():
    """Of pairs of sets at a likeness of 0.8, 0.85 and 0.9: those that share a key and lie within the limits."""
    rng = np.random.default_rng(3)
    for cut, least in ((10, 0.93), (7, 0.98), (4, 0.999)):  # of 90 + cut elements 90 - cut are common
        a, b = [], []
        for _ in range(1500):
            x = rng.integers(0, 2**64, 90 + cut, dtype=np.uint64)
            a.append(simhash.wide_fingerprint(x[:90]))
            b.append(simhash.wide_fingerprint(x[cut:]))
        a, b = np.array(a), np.array(b)
        met = [set() for _ in range(1500)], [set() for _ in range(1500)]
        for side, fps in zip(met, (a, b), strict=True):
            for row, key in zip(*[x.tolist() for x in simhash.wide_keys(fps)], strict=True):
                side[row].add(key)
        near = (np.bitwise_count(a ^ b).sum(axis=1) <= simhash.CLOSE) & (np.bitwise_count(a[:, 0] ^ b[:, 0]) <= simhash.LOOSE)
        assert np.mean([bool(x & y) and bool(n) for x, y, n in zip(*met, near, strict=True)]) >= least


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(70)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5), (None, 3), (2000, 2001), (2001, 2000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(71)) and all(got[1000 + i] == 1000 for i in range(60)) and got[2001] == 2000
    assert len(got) == 71 + 60 + 2
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []
