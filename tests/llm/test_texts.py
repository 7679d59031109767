"""Language identification (6), HTML extraction (4), the pipeline."""

import zlib

import numpy as np
import pytest
from brute import brute_covered, brute_jaccard, brute_language, brute_lines
from pyspark.sql import functions as F

from vaultline.llm import html, language

ENGLISH = ["the cat sat on the mat and looked at the moon", "there is nothing here but the wind in the trees"]
GERMAN = ["die katze saß auf der matte und sah den mond an", "hier ist nichts außer dem wind in den bäumen"]


def test_language(docs, spark):
    texts = [x for i in range(40) for x in (f"{ENGLISH[i % 2]} {i}", f"{GERMAN[i % 2]} {i}")] + ["", None, "123 !? ² Ⅷ", "windmoon treecat"]
    rows = [(i, t, None if i > 79 else ("en", "de")[i % 2], 3.0, "q") for i, t in enumerate(texts)] + [(None, ENGLISH[0], "en", 1.0, "q"), (1, texts[1], "de", 1.0, "q")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    got = language.identify(table).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id is not None and r.doc_id < 80:
            assert r.lang_pred == ("en", "de")[r.doc_id % 2] and r.score > 0.9
    by = {r.doc_id: r for r in got}
    assert [by[80].lang_pred, by[81].lang_pred, by[82].lang_pred] == ["und"] * 3 and by[80].score == 0
    assert by[83].lang_pred == "en"  # unseen words, by their n-grams
    kept = language.keep_identified(table)
    assert kept.columns == table.columns and kept.count() == len(rows) - 3
    assert {r.lang_pred for r in kept.collect()} == {"q"}


def test_lang_column_is_no_input(docs, spark):
    model = language.fit(spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate([(ENGLISH[0], "en"), (GERMAN[0], "de")] * 5)], "doc_id long, text string, lang string"))
    liars = spark.createDataFrame([(1, ENGLISH[1], "de"), (2, GERMAN[1], "en")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.predict(liars, model).orderBy("doc_id").collect()] == ["en", "de"]


def test_no_labelled_rows(docs, spark):
    table = docs([ENGLISH[0]]).drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert [(r.lang_pred, r.score) for r in language.identify(table).collect()] == [("und", 0.0)]
    assert language.identify(table.where("false")).collect() == []


def test_backoff_orders():
    import numpy as np

    table = np.array([[-1.0, -2.0], [-3.0, -4.0], [-9.0, -8.0]])
    model = language.LanguageModel(["a", "b"], np.zeros(2), {"known": 0}, {"^un": 1, "x": 2}, table, np.array([-20.0, -20.0]))
    assert model.of_word("known").tolist() == [-1, -2]
    assert model.of_word("unix").tolist() == [-3, -4]  # the longest known n-gram, not the shorter x
    assert model.of_word("xy").tolist() == [-9, -8]
    assert model.of_word("qq").tolist() == [-20, -20]


def test_languages_equal_a_plain_scorer(spark):
    """All documents of the smallest table, predicted word by word in plain Python."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows += [(None, "the", None), (7, "das und the", "de"), (7, "das und the", "en"), (8, None, "de"), (9, "x" * 3000, "en"), (10, "12 ²", "fr")]
    table = spark.createDataFrame([(*r, 0.5, "y") for r in rows], "doc_id long, text string, lang string, score double, backed string")
    held = [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows]
    want = brute_language([t for _, t, _ in rows], [k for *_, k in rows], held)
    expected = sorted((str(i), h, k, round(s, 6)) for (i, *_), h, (k, s, _) in zip(rows, held, want, strict=True))
    got = language.identify(table).collect()
    assert sorted((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 6)) for r in got) == expected


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)


def test_what_was_not_learned_is_rejected(docs):
    texts = ENGLISH * 4 + GERMAN * 4 + ["кошка сидит на ковре и смотрит на луну", "猫がマットの上に座っています"]
    made = docs(texts).withColumn("lang", F.when(F.col("doc_id") < 8, "en").when(F.col("doc_id") < 16, "de"))
    assert sorted(r.doc_id for r in language.keep_identified(made).collect()) == list(range(16))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body class="x">
<nav><ul><li><a href="/a">menu {i}</a></ul></nav><div class="ad">buy {i}</div><article><h1>Title &amp; {i}</h1>
<p>First  para\n {i}<p><b>Second {i}<br>line</b></p><p>Share this page</p><form>mail {i}</form><section id="comments"><p>first! {i}</p></section></article>
<div class="cookie-notice">we use {i}</div><footer>&copy; {i}</footer></body></html>"""


def test_extract(spark):
    rows = [(i, f"http://h.org/{i}", PAGE.format(i=i), "e") for i in range(12)]
    rows += [(20, None, "<p>alone &lt;b&gt; &amp</p>plain", "e"), (21, "http://x.org/", None, "e"), (22, "http://x.org/", "", "e"), (23, "http://y.org/", "<p>unclosed <a title='x>y", "e"), (None, "http://h.org/z", PAGE.format(i=3), "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    for i in range(12):
        # the paragraph that is the same on all pages of the host is template
        assert got[i].text == f"Title & {i}\nFirst para {i}\nSecond {i} line" and got[i].n_chars == len(got[i].text) and got[i].url == f"http://h.org/{i}"
    assert got[20].text == "alone <b> &\nplain" and got[21].text == got[22].text == "" and got[21].n_chars == 0
    assert html.extract(pages).count() == len(rows)
    assert html.extract(pages.where("false")).collect() == []


def test_copies_of_a_page_are_no_template(spark):
    pages = spark.createDataFrame([(i, "http://h.org/", PAGE.format(i=1)) for i in range(30)], "page_id long, url string, html string")
    assert {r.text for r in html.extract(pages).collect()} == {"Title & 1\nFirst para 1\nSecond 1 line\nShare this page"}


SCHEMA = "page_id long, url string, html string"


def test_alignment_finds_what_has_no_telling_name(spark):
    """Menus, notices and adverts in plain divs go because they are the same, or links, on the host's pages."""
    say = lambda i, k: f"Text {k} of page {i} goes on about matter {i * 31 + k}."
    links = lambda i: "".join(f"<a href='/{i}{k}'>word{i}{k}</a> " for k in range(4))
    source = "<html><body><div class='x1'>{m}</div><div class='x2'>Our great offer</div><div class='x3'>{t}</div><div class='x4'>All rights belong to us</div></body></html>"
    article = lambda i: f"<h1>Head {i}</h1>" + "".join(f"<p>{say(i, k)}</p>" for k in range(2 + i % 4))
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", source.format(m=links(i), t=article(i))) for i in range(12)], SCHEMA)
    want = {i: "\n".join([f"Head {i}", *[say(i, k) for k in range(2 + i % 4)]]) for i in range(12)}
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == want
    off = {r.page_id: r.text for r in html.extract(pages, alignment=False).collect()}
    assert all(off[i] == "Our great offer\n" + want[i] + "\nAll rights belong to us" for i in range(12))


def test_layouts_have_references_of_their_own(spark):
    notice = "<div>We are closed today</div>"
    source = "<html><body>{n}<p>Body of {i}, no other page has it</p><section>About us</section></body></html>"
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", source.format(i=i, n=notice if i % 2 else "")) for i in range(12)], SCHEMA)
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == {i: f"Body of {i}, no other page has it" for i in range(12)}


def test_names_are_a_weak_prior(spark):
    inside = "<article><h2 id='notice'>Notice {i}</h2><div class='related-work'>Related work is discussed here, {i}.</div><div class='no-sidebar'>One {i}</div><div class='ad'>Buy {i}</div></article>"
    around = "<div class='sidebar'><h1>Title {i}</h1><p>All of the text, {i}, is in a box of that name.</p></div>"
    shell = "<main><p>{i}</p></main><div><p>The story number {i} is long and stands outside of a main element that holds a number.</p></div>"
    rows = [(100 * k + i, f"http://h{k}.org/{i}", f"<body>{t.format(i=i)}</body>") for k, t in enumerate((inside, around, shell)) for i in range(5)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(5):
        assert got[i] == f"Notice {i}\nRelated work is discussed here, {i}.\nOne {i}"
        assert got[100 + i] == f"Title {i}\nAll of the text, {i}, is in a box of that name."
        assert got[200 + i] == f"{i}\nThe story number {i} is long and stands outside of a main element that holds a number."


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 5000 + "down here {i}" + "</div>" * 5000
    wide = "<table>" + "<tr><td>a {i}<td>b</tr>" * 3000 + "</table>" + "<p>w {i}</p>" * 3000
    rows = [(10 * k + i, f"http://h{k}.org/{i}", t.format(i=i)) for k, t in enumerate((deep, wide)) for i in range(4)]
    rows += [(30, "http://h0.org/", "<div>" * 600 + "x" + "</div>" * 600), (31, "http://h1.org/", "<p>w y</p>" * 20_000 + "<table><tr><td>z</table>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(4):
        assert got[i] == f"down here {i}" and got[10 + i].count(f"w {i}") == 3000 and got[10 + i].count(f"a {i}") == 3000
    assert got[30] == "x" and got[31].count("w y") == 20_000


def slow_match(a, b):
    """The number of nodes that simple tree matching pairs in trees (tag, children...)."""
    if a[0] != b[0]:
        return 0
    m = [[0] * len(b) for _ in a]
    for i in range(1, len(a)):
        for j in range(1, len(b)):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + slow_match(a[i], b[j]))
    return 1 + m[-1][-1]


def test_simple_tree_matching():
    rng = np.random.default_rng(11)

    def tree(depth):
        kids = [] if depth == 0 else [tree(depth - 1) for _ in range(int(rng.integers(0, 6)))]
        return (str(rng.choice(list("abc"))), *kids)

    def flat(t, parent, parents, tags):
        parents.append(parent)
        tags.append(t[0])
        me = len(tags) - 1
        for k in t[1:]:
            flat(k, me, parents, tags)
        return parents, tags

    for _ in range(150):
        a, b = tree(3), tree(3)
        forest = html.Forest()
        flats = [flat(t, -1, [], []) for t in (a, b)]
        pairs = forest.align(*[forest.add(*f) for f in flats])
        assert len(pairs) - 1 == slow_match(a, b)
        (pa_, ta), (pb, tb) = flats
        for i, j in pairs.items():
            assert not i or (ta[i - 1] == tb[j - 1] and pairs[pa_[i - 1] + 1] == pb[j - 1] + 1)
        order = sorted(pairs.items())
        assert [j for _, j in order] == sorted(j for _, j in order)  # siblings stay in order
    a, b = [int(x) for x in rng.integers(0, 2, 300)], [int(x) for x in rng.integers(0, 2, 200)]
    made = [("t", *[("x", ("y",), ("z",)) if v else ("p",) for v in side]) for side in (a, b)]
    forest = html.Forest()
    assert len(forest.align(*[forest.add(*flat(t, -1, [], [])) for t in made])) - 1 == slow_match(*made)


@pytest.mark.parametrize("source", ["<" * 3000, "<div>" * 3000, "<p>" * 3000, '<a b="' * 500, "<!-- x", "<script>x", "&#x110000; &#0; &bogus;", "</div></p><li><td>x"])
def test_broken_html(source):
    assert isinstance(html.Page(source).blocks, list)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(2)
    words = {k: ["".join(rng.choice(list(a), int(rng.integers(2, 9)))) for _ in range(200)] for k, a in (("en", "abcdefgh"), ("de", "stuvwxyz"))}
    say = lambda k, n: " ".join(rng.choice(words[k], n))
    texts = [say("en", 60) for _ in range(20)] + [say("de", 60) for _ in range(20)]
    texts += [texts[0], texts[1] + " tail", "", None, "1234", texts[2] + "\n" + say("en", 40)]
    rows = [(i, t, "en" if i < 20 else "de", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, str(tmp_path))
        assert new.columns == docs.columns, name
        new.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.where("n_chars <> length(text)").isEmpty()
        sizes.append(docs.count())
    assert sizes[0] == 43 and sizes[1] == 41  # without empty, null and 1234; then without the copies in whole lines
    ids = {r.doc_id for r in docs.collect()}
    assert set(range(40)) <= ids  # clean documents stay
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == ids and all(r.offset + r.length <= 2048 for r in out)


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage on all that the one before kept, in plain Python: languages, lines, likeness of shingles, strings, token ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = np.random.default_rng(6)
    words = {k: ["".join(rng.choice(list(a), int(rng.integers(2, 9)))) for _ in range(300)] for k, a in (("en", "abcdefgh"), ("de", "stuvwxyz"))}
    say = lambda k, n: " ".join(rng.choice(words[k], n))
    texts, langs = [], []
    for i in range(60):
        k = "en" if i % 3 else "de"
        rows = [say(k, int(rng.integers(3, 50))) for _ in range(int(rng.integers(1, 4)))]
        if i % 4 == 0:
            rows[0] = f"{say(k, 20)} {say(k, 70) if i < 4 else passages[k]} {say(k, 20)}"
        if i < 2:
            passages = {k: say(k, 70) for k in words}
        if i % 5 == 0 and i:
            rows = texts[i - 5].split("\n")
            rows[0] += " " + say(k, i % 3)
        texts.append("\n".join(rows))
        langs.append(k)
    long = say("en", 120).split(" ")
    for j in range(4):  # near copies that the line stage leaves: three words differ from line to line
        copy = list(long)
        for at in (10 + j, 60 + j, 100 + j):
            copy[at] = f"odd{'abcd'[j]}"
        texts.append(" ".join(copy))
        langs.append("en")
    texts += [None, "", "12 34 ½", texts[7], texts[8] + "\n" + passages["en"], "кошка сидит на ковре", say("en", 9000)]
    langs += ["en", None, "en", "en", None, None, "en"]
    rows = [(3 * i, t, k, i) for i, (t, k) in enumerate(zip(texts, langs, strict=True))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, rest int").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    held = [zlib.crc32(str(3 * i).encode()) % 4 == 2 for i in range(len(texts))]
    told = brute_language(texts, langs, held)
    left = [(3 * i, t) for i, (t, (k, score, backed)) in enumerate(zip(texts, told, strict=True)) if k != "und" and score >= 0.5 and backed >= 0.5]
    assert len(left) == len(texts) - 4
    gone = brute_lines([t for _, t in left])
    cut = [(d, "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone.get(i, ()))) for i, (d, t) in enumerate(left)]
    left = [(d, t) for i, (d, t) in enumerate(cut) if not (gone.get(i) and not t.strip())]
    group = brute_jaccard([t for _, t in left])
    assert sum(i != g for i, g in enumerate(group)) >= 3
    left = [x for i, (x, g) in enumerate(zip(left, group, strict=True)) if i == g]
    expected = {}
    for (d, _), (data, hit) in zip(left, brute_covered([t for _, t in left]), strict=True):
        expected[d] = bytes(np.frombuffer(data, np.uint8)[~hit]).decode()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    got = {r.doc_id: r.text for r in docs.collect()}
    assert got == expected and len(got) < 66 and sum(map(len, got.values())) < sum(len(t) for _, t in left)
    assert all(r.rest * 3 == r.doc_id for r in docs.collect())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = {}, {}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, t in expected.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(pieces.pop(d), key=lambda r: r.piece)
        assert [(r.start, r.start + r.length) for r in mine][0][0] == 0 and sum(r.length for r in mine) == len(ids)
        assert [r.ids_crc32 for r in mine] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine]
    assert not pieces and all([o for o, _ in sorted(x)] == [0, *np.cumsum([n for _, n in sorted(x)])[:-1]] and sum(n for _, n in x) <= 2048 for x in sequences.values())


def test_pipeline_takes_any_rows(spark, tmp_path):
    """Null and repeated ids, null and very long texts, rows that repeat, clashing names; and no rows at all."""
    import corpus_pipeline

    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 9)))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words, n))
    own = [say(80) for _ in range(8)]
    rows = [(None, own[0]), (None, own[1]), (5, own[2]), (5, own[3]), (6, own[4]), (6, own[4]), (None, None), (7, None), (8, ""), (9, say(40_000)), (None, own[5]), (None, own[5])]
    schema = "doc_id long, text string, lang string, row string, node string, doc string, tag string, key string, rest string, n_chars int"
    made = spark.createDataFrame([(*r, "en", *"abcdef", 0) for r in rows], schema)
    for name, table in (("some", made), ("none", made.where("false"))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for stage, run in corpus_pipeline.STAGES[:-1]:
            out = run(spark, docs, f"{tmp_path}/{name}")
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}/{stage}")
            docs = spark.read.parquet(f"{tmp_path}/{name}/{stage}")
        if name == "none":
            assert docs.collect() == [] and corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
            continue
        kept = docs.collect()
        assert {r.text for r in kept} >= set(own[:4]) and all(r.row == "a" and r.key == "e" and r.n_chars == len(r.text) for r in kept)
        assert sum(r.text == own[4] for r in kept) <= 1 and sum(r.text == own[5] for r in kept) <= 1
        assert max(len(r.text) for r in kept if r.doc_id == 9) > 100_000
