"""Line dedup by a deletion-neighbourhood join (operator 5).

A line is its words, in lower case. Lines of at least MIN_WORDS (a parameter) words are compared: equal ones are duplicates, and of those
with at least NEAR_WORDS (another) also those within an edit of one word. Two such lines have a variant in common: themselves with
one word (or none) deleted. Variants become hashed keys; lines that share one are joined through the earliest line of each
key, and the edit distance is verified on the words. A line is removed if an earlier one, by doc_id and line number, is a
duplicate of it, whether that one stays or not.

Most lines have no neighbour. Before variants are made, a cheap test drops lines that can't have any: an edit lies in one
half of a line, so that neighbours agree in the words of the other half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ddl, slices
from .common import discard, free_shuffles, map_arrow, packed, table, unpacked, written

MIN_WORDS, NEAR_WORDS = 5, 10
#: An odd multiplier and its inverse modulo 2^64.
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 2**64)
_hash = lambda s, seed=0: xxhash.xxh64_intdigest(s, seed) - (1 << 63)


def words_of(line: str) -> list[str]:
    return line.lower().split()


def halves(words: list[str]) -> list[int]:
    """Hashes of the first and of the last words, as many as a neighbour of the same length, or one word more or less, shares."""
    n, out = len(words), []
    for c in {(n - 1) // 2, (n - 2) // 2}:
        out += [_hash(" ".join(words[:c]), 2 * c + 1), _hash(" ".join(words[n - c :]), 2 * c + 2)]
    return out


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether the edit distance of two word lists is one at most."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


#: What tells a row apart, in the order of documents: rows without an id come last, rows with equal ids are ordered by a hash of
#: their texts. Rows with the same id and the same text are one document.
IDENTITY = "doc long, tag long"
OWN = ["doc", "tag"]


def _identity() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"), F.xxhash64("text").alias("tag")]


def _batch(out: list[tuple], names: list[str], kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def hashed_lines(docs: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """doc, tag, line, h1, h2 (the line's 128-bit hash), keys (of its halves; none if it is too short for a near duplicate)."""
    names = [*OWN, "line", "h1", "h2", "keys"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                out: list[tuple] = []
                for doc, tag, text in zip(*[b.column(c).to_pylist() for c in (*OWN, "text")], strict=True):
                    for i, line in enumerate(text.split("\n")):
                        words = words_of(line)
                        if len(words) >= min_words:
                            joined = " ".join(words)
                            out.append((doc, tag, i, _hash(joined), _hash(joined, 1), halves(words) if len(words) >= near_words else []))
                yield _batch(out, names, kinds)

    rows = docs.where("text is not null").select(*_identity(), "text")
    return map_arrow(rows, run, f"{IDENTITY}, line int, h1 long, h2 long, keys array<long>")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, tag, line, words for the lines in `wanted` (doc, tag, line), which are few of their documents."""
    per_doc = wanted.groupBy(OWN).agg(F.collect_set("line").alias("lines"))
    # what grows with the corpus is merged, not broadcast, at every size
    rows = docs.where("text is not null").select(*_identity(), "text").join(per_doc.hint("merge"), OWN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                out: list[tuple] = []
                for doc, tag, text, lines in zip(*[b.column(c).to_pylist() for c in (*OWN, "text", "lines")], strict=True):
                    split = text.split("\n")
                    out += [(doc, tag, i, words_of(split[i])) for i in lines]
                yield _batch(out, [*OWN, "line", "words"], (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string())))

    return map_arrow(rows.select(*OWN, "text", "lines"), run, f"{IDENTITY}, line int, words array<string>").distinct()


def variant_hashes(words: list[str]) -> np.ndarray:
    """Hashes of the line as it is, and with each of its words deleted, in time proportional to its length.

    A sequence hashes to the sum of its words' hashes times powers of BASE, the last word's 1; without word i the words
    before it lose one power each.
    """
    n = len(words)
    w = np.fromiter((xxhash.xxh64_intdigest(x) for x in words), np.uint64, n)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE, np.uint64)]), dtype=np.uint64)[:n][::-1]
    before = np.concatenate([[np.uint64(0)], np.cumsum(w * powers, dtype=np.uint64)])
    rest = before[:-1] * np.uint64(INVERSE) + (before[-1] - before[1:])
    h = np.concatenate([before[-1:], rest])
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def variants(lines: DataFrame) -> DataFrame:
    """doc, tag, line, key, at for each line of (doc, tag, line, words): with word `at` deleted, or as it is (-1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 500):
                b = whole.slice(k, 500)
                keys = [variant_hashes(w) for w in b.column("words").to_pylist()]
                sizes = [len(x) for x in keys]
                at = np.concatenate([np.arange(-1, n - 1, dtype=np.int32) for n in sizes])
                own = [pa.array(np.repeat(b.column(c).to_numpy(), sizes)) for c in (*OWN, "line")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate(keys)), pa.array(at)], [*OWN, "line", "key", "at"])

    return map_arrow(lines, run, f"{IDENTITY}, line int, key long, at int")


def duplicates(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """(doc, tag, line) of every line to remove, each once, written."""
    spot = [*OWN, "line"]
    place = F.struct(*spot)
    hashed = written(hashed_lines(docs, min_words, near_words), "lines")
    first = hashed.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.first("keys").alias("keys"))
    first = written(first, "first")
    own = hashed.select("h1", "h2", *spot).join(first.select("h1", "h2", "first"), ["h1", "h2"])
    exact = written(own.where(F.col("first") != place).select(*spot), "exact")
    free_shuffles(docs.sparkSession)

    keyed = first.where(F.size("keys") > 0).select("first.*", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    candidates = written(keyed.join(shared, "key", "left_semi").select(*spot).distinct(), "candidates")
    free_shuffles(docs.sparkSession)
    words = written(_texts(docs, candidates), "words")
    free_shuffles(docs.sparkSession)
    made = written(variants(words), "variants")
    deleted, as_is = made.where("at >= 0"), made.where("at < 0").select("key", place.alias("full"))
    # another word in the same place: both lines have the same rest
    least = deleted.groupBy("key", "at").agg(F.min(place).alias("witness"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = deleted.join(least, ["key", "at"]).select(place.alias("late"), "witness")
    # a word more: the longer line without it is the shorter one
    met = deleted.select("key", place.alias("long")).join(as_is, "key")
    more = met.select(F.greatest("long", "full").alias("late"), F.least("long", "full").alias("witness"))
    pairs = same.unionByName(more).where("witness < late").distinct()
    text = lambda side: words.select(place.alias(side), F.col("words").alias(f"{side}_words"))
    both = pairs.join(text("late"), "late").join(text("witness"), "witness")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, w = b.column("late_words").to_pylist(), b.column("witness_words").to_pylist()
            ok = [within_one(x, y) for x, y in zip(a, w, strict=True)]
            yield b.select(spot).filter(pa.array(ok, pa.bool_()))

    near = map_arrow(both.select("late.*", "late_words", "witness_words"), verified, f"{IDENTITY}, line int")
    out = written(exact.unionByName(near).distinct(), "duplicates")
    discard(hashed, first, exact, candidates, words, made)
    return out


def without_duplicates(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """`docs` with text without its duplicate lines, n_lines (before) and removed_lines (array<int>, numbers from 0).

    Lines are split at \\n and joined again. Lines under `min_words` words stay (headings, list marks and the like, which
    repeat by nature); those from there on go if equal to an earlier one, from `near_words` on also if within an edit of one
    word. Null texts have no line. Documents are in order of doc_id, those without one last; rows with one id and different
    texts are documents of their own, in order of a hash of the text; rows with one id and the same text are treated alike.
    An empty table gives an empty result; columns named n_lines or removed_lines are replaced, others stay.
    """
    found = duplicates(docs, min_words, near_words)
    own = [F.col("doc").alias("_doc"), F.col("tag").alias("_tag")]
    gone = found.groupBy(*own).agg(F.sort_array(F.collect_list("line")).alias("removed_lines"))
    gone = written(gone, "gone")
    discard(found)
    free_shuffles(docs.sparkSession)
    kept = docs.drop("removed_lines", "n_lines")
    doc, tag = _identity()
    mine = (doc == F.col("_doc")) & (tag == F.col("_tag"))
    joined = packed(kept, "doc_id", "text").join(gone.hint("merge"), mine, "left").drop("_doc", "_tag")
    text = joined.schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                texts, counts, removed = [], [], []
                for t, gone in zip(b.column("text").to_pylist(), b.column("removed_lines").to_pylist(), strict=True):
                    lines, out = t.split("\n") if t is not None else [], set(gone or ())
                    texts.append("\n".join([x for i, x in enumerate(lines) if i not in out]) if out and t is not None else t)
                    counts.append(len(lines))
                    removed.append(sorted(i for i in out if i < len(lines)))
                columns = list(b.columns)
                columns[text], columns[-1] = pa.array(texts, pa.string()), pa.array(removed, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*b.schema.names, "n_lines"])

    rows = map_arrow(joined, run, f"{ddl(joined)}, n_lines long")
    return rows.select(*[F.col(f"`{c}`") if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in kept.columns], "n_lines", "removed_lines")


def keep_new_lines(docs: DataFrame) -> DataFrame:
    """`docs` without duplicate lines; documents of which no words stay go too, as all of their text stands in earlier ones."""
    rest = without_duplicates(packed(docs, "doc_id", "text"))
    emptied = (F.size("removed_lines") > 0) & (F.trim("text") == "")
    return unpacked(rest.where(~F.coalesce(emptied, F.lit(False))).drop("n_lines", "removed_lines"), docs)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines (a comma list), kept_sha256 (of the text that stays; a null text counts as empty)."""
    rest = without_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    return rest.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), F.array_join("removed_lines", ",").alias("removed_lines"), digest)


OP5_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, line, list_filter(regexp_split_to_array(lower(line), '\s+'), lambda x: x <> '') AS w FROM l),
k AS (SELECT doc_id, i, w, len(w) AS n FROM w WHERE len(w) >= 5),
f AS (SELECT w, n, min((doc_id, i)) AS first FROM k GROUP BY w, n),
exact AS (SELECT k.doc_id, k.i FROM k JOIN f ON k.w = f.w WHERE (k.doc_id, k.i) <> f.first),
q AS (SELECT a.first AS late, a.w AS x, b.w AS y, a.n AS n, b.n AS m,
    coalesce(list_position(list_transform(list_zip(a.w[:least(a.n, b.n)], b.w[:least(a.n, b.n)]), lambda z: z[1] = z[2]), false), least(a.n, b.n) + 1) AS p
  FROM f a JOIN f b ON b.n BETWEEN a.n - 1 AND a.n + 1 AND b.first < a.first WHERE a.n >= 10 AND b.n >= 10),
near AS (SELECT DISTINCT late FROM q WHERE x[p + CASE WHEN n >= m THEN 1 ELSE 0 END:] = y[p + CASE WHEN m >= n THEN 1 ELSE 0 END:]),
gone AS (SELECT doc_id, i FROM exact UNION SELECT late[1], late[2] FROM near),
o AS (SELECT w.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(g.i::VARCHAR, ',' ORDER BY g.i) FILTER (g.i IS NOT NULL), '') AS removed_lines,
    coalesce(string_agg(w.line, chr(10) ORDER BY w.i) FILTER (g.i IS NULL), '') AS kept
  FROM w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed_lines, '') AS removed_lines, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id
"""
