"""Removal of repeated byte strings by prefix-free parsing (operator 7).

A byte goes if a 200-byte string that covers it also starts elsewhere. As in prefix-free parsing, a rolling hash picks triggers
that depend on a few bytes only, here the smallest hash of each 200-byte string, so that every such string has one; strings in
a row with the same trigger make a phrase, which overlaps the next by 199 bytes: every string lies in one phrase. The distinct
phrases are the dictionary, and the corpus its parse. A phrase that occurs twice repeats as a whole, however often it does.

What remains are strings in phrases that occur once. Equal strings have the same trigger at the same offset, and agree in the
84 bytes before it or after it; only phrases that share such a half with another phrase of the dictionary can hold one. Their
suffixes are sorted (prefix doubling on ranks, from 8 bytes to 200) within the shared half, and suffixes that share 200 bytes
with a neighbour in that order are repeats. The order of all other suffixes of the corpus decides nothing and isn't made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ddl, slices
from .common import discard, free_shuffles, map_arrow, packed, table, unpacked, written

LENGTH, WINDOW = 200, 24
#: Windows in a string; with HALF bytes before the trigger window or after it, one of both lies in every string.
SPAN = LENGTH - WINDOW + 1
HALF = (LENGTH - WINDOW) // 2
_MASK = np.uint64(0xFFFFFFFF)


def parse(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, first, last) of each phrase: strings starting at first to last have their trigger at this place."""
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64),) * 3
    h = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    # the hash of WINDOW = 16 + 8 bytes from those of halves
    power, size, of = 0x9E3779B97F4A7C15, 1, {}
    powers = {1: power}
    while size < 16:
        h = h[:-size] * np.uint64(powers[size]) + h[size:]
        powers[2 * size] = powers[size] ** 2 % 2**64
        size *= 2
        of[size] = h
    h = of[16][: len(data) - WINDOW + 1] * np.uint64(powers[8]) + of[8][16 : 16 + len(data) - WINDOW + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    m = ((h ^ (h >> np.uint64(29))) & ~_MASK) | np.arange(len(h), dtype=np.uint64)  # ties: the first place
    size = 1
    while 2 * size <= SPAN:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    m = np.minimum(m[: len(m) - (SPAN - size)], m[SPAN - size :])
    trigger = (m & _MASK).astype(np.int64)
    first = np.flatnonzero(np.append(True, trigger[1:] != trigger[:-1]))
    return trigger[first], first, np.append(first[1:], len(trigger)) - 1


def _sides(trigger: int, first: int, last: int) -> list[tuple[int, int, int, int]]:
    """(key from, key to, first, last) for strings with HALF bytes before their trigger, and for the others, which have as many after."""
    out = []
    if trigger - first >= HALF:
        out.append((trigger - HALF, trigger + WINDOW, first, min(last, trigger - HALF)))
    if trigger - last < HALF:
        out.append((trigger, trigger + WINDOW + HALF, max(first, trigger - HALF + 1), last))
    return out


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _phrases(docs: DataFrame, halves: bool) -> DataFrame:
    """k1, k2 (128-bit hash), doc, tag, trigger, first, last of every phrase; with halves also the keys of its two sides (or null)."""
    names = ["k1", "k2", "doc", "tag", "trigger", "first", "last", *["before", "after"] * halves]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 1_000_000):
                digests, places, counts, keys = [], [], [], ([], [])
                for text in b.column("text").to_pylist():
                    data = _bytes(text)
                    t, f, l = parse(data)
                    places.append((t, f, l))
                    counts.append(len(t))
                    digest = xxhash.xxh3_128_digest
                    digests += [digest(data[x : y + LENGTH]) for x, y in zip(f.tolist(), l.tolist(), strict=True)]
                    if halves:
                        key = xxhash.xxh3_64_intdigest
                        ok = (t - f >= HALF).tolist(), (t - l < HALF).tolist()
                        at = t.tolist()
                        keys[0].extend([key(data[x - HALF : x + WINDOW], 1) - (1 << 63) if y else None for x, y in zip(at, ok[0], strict=True)])
                        keys[1].extend([key(data[x : x + WINDOW + HALF], 2) - (1 << 63) if y else None for x, y in zip(at, ok[1], strict=True)])
                k = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                t, f, l = (np.concatenate([p[i] for p in places]) if places else np.zeros(0, np.int64) for i in range(3))
                own = [np.repeat(b.column(c).to_numpy(), counts) for c in ("doc", "tag")]
                columns = [k[:, 0], k[:, 1], *own, *[x.astype(np.int32) for x in (t, f, l)]]
                arrays = [pa.array(np.ascontiguousarray(c)) for c in columns] + [pa.array(x, pa.int64()) for x in keys] * halves
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "k1 long, k2 long, doc long, tag int, trigger int, first int, last int" + ", before long, after long" * halves
    return map_arrow(docs, run, schema)


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, doc, tag, start, once, context: the bytes of the strings of one side of each wanted phrase (doc, tag, trigger, ...)."""
    place = F.struct("trigger", "first", "last", "before", "after", "once")
    per_doc = wanted.groupBy("doc", "tag").agg(F.collect_list(place).alias("phrases"))
    rows = docs.join(per_doc, ["doc", "tag"]).select("doc", "tag", "text", "phrases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 1_000_000):
                out: list[tuple] = []
                for doc, tag, text, phrases in zip(*[b.column(c).to_pylist() for c in ("doc", "tag", "text", "phrases")], strict=True):
                    data = _bytes(text)
                    for p in phrases:
                        for a, z, first, last in _sides(p["trigger"], p["first"], p["last"]):
                            key = xxhash.xxh3_64_intdigest(data[a:z], 1 if a < p["trigger"] else 2) - (1 << 63)
                            if p["before" if a < p["trigger"] else "after"]:
                                out.append((key, doc, tag, first, p["once"], data[first : last + LENGTH]))
                columns = list(zip(*out, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "doc", "tag", "start", "once", "context"])

    return map_arrow(rows, run, "key long, doc long, tag int, start int, once boolean, context binary")


def repeated_suffixes(contexts: list[bytes]) -> np.ndarray:
    """For every byte of the joined contexts: whether the LENGTH bytes from there lie in its context and occur twice in all."""
    data = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8)
    n = len(data) - 8
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    room = np.repeat(np.cumsum(sizes).astype(np.uint32), sizes) - np.arange(n, dtype=np.uint32)
    at = np.flatnonzero(room >= LENGTH)
    del room
    found = np.zeros(n, bool)
    if not len(at):
        return found

    def ranked(keys: np.ndarray) -> np.ndarray:
        """Each key's place among the distinct keys in order."""
        order = np.argsort(keys)
        new = np.empty(len(keys), np.uint32)
        new[0], new[1:] = 0, keys[order[1:]] != keys[order[:-1]]
        out = np.empty(len(keys), np.uint32)
        out[order] = np.cumsum(new, dtype=np.uint32)
        return out

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint64)
        keys <<= np.uint64(32)
        keys |= b
        return keys

    keys = np.zeros(n, np.uint64)
    for i in range(8):
        keys <<= np.uint64(8)
        keys |= data[i : n + i]
    ranks, size = {8: ranked(keys)}, 8
    del keys
    while size < 128:
        ahead = np.zeros(n, np.uint32)
        ahead[: max(0, n - size)] = ranks[size][size:]
        ranks[2 * size] = ranked(joined(ranks[size], ahead))
        if size > 8:
            del ranks[size]
        size *= 2
        if size == 64:
            low = ranked(joined(ranks[64][at + 128], ranks[8][at + 192]))  # 200 = 128 + 64 + 8
    whole = ranked(joined(ranks[128][at], low))  # the suffixes' order, as far as their first 200 bytes tell
    found[at] = np.bincount(whole)[whole] > 1
    return found


def _repeats(contexts: DataFrame, most: int, chunk: int = 1_000_000) -> DataFrame:
    """(doc, tag, a, b): runs of starts of strings that occur twice, from contexts (key, doc, tag, start, once, context), written.

    Contexts of one key are sorted together, in chunks of whole keys. Those of a key with over `most` bytes never meet in one
    task: they are cut into their single strings, which meet by their hashes instead, counted before they are shuffled.
    """
    hot = contexts.groupBy("key").agg(F.sum(F.length("context")).alias("n")).where(F.col("n") > most).select("key")
    hot = written(hot, "hot")
    names = ["doc", "tag", "a", "b"]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())

    def made(out: list[tuple], names: list[str], kinds: tuple) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def runs(part: list[tuple]) -> pa.RecordBatch:
        out, found, at = [], repeated_suffixes([p[5] for p in part]), 0
        for _, doc, tag, start, once, context in part:
            if once:
                hit = np.flatnonzero(np.diff(found[at : at + len(context)].astype(np.int8), prepend=0, append=0))
                out += [(doc, tag, start + a, start + b - 1) for a, b in hit.reshape(-1, 2).tolist()]
            at += len(context)
        return made(out, names, kinds)

    def rows_of(b: pa.RecordBatch) -> Iterator[tuple]:
        return zip(*[b.column(c).to_pylist() for c in ("key", "doc", "tag", "start", "once", "context")], strict=True)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        size = 0
        for b in batches:
            for row in rows_of(b):
                if size > chunk and row[0] != part[-1][0]:
                    yield runs(part)
                    part, size = [], 0
                part.append(row)
                size += len(row[5])
        if part:
            yield runs(part)

    def singly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 200):
                out = []
                for _, doc, tag, start, once, context in rows_of(whole.slice(i, 200)):
                    for k in range(len(context) - LENGTH + 1):
                        h = xxhash.xxh3_128_intdigest(context[k : k + LENGTH])
                        out.append(((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), doc, tag, start + k, once))
                yield made(out, ["h1", "h2", "doc", "tag", "a", "once"], (*[pa.int64()] * 3, *[pa.int32()] * 2, pa.bool_()))

    cold = contexts.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    near = map_arrow(cold, together, "doc long, tag int, a int, b int")
    if hot.isEmpty():
        out = written(near, "partial")
        discard(hot)
        return out
    single = written(map_arrow(contexts.join(hot, "key", "left_semi").select(*contexts.columns), singly, "h1 long, h2 long, doc long, tag int, a int, once boolean"), "single")
    twice = single.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    met = single.where("once").join(twice, ["h1", "h2"], "left_semi").select("doc", "tag", "a", F.col("a").alias("b"))
    out = written(near.unionByName(met), "partial")
    discard(hot, single)
    return out


def covered(docs: DataFrame, most: int = 3_000_000) -> DataFrame:
    """(doc, tag, spans): for each document with a repeated string, its runs of starts as arrays [from, to].

    docs: doc, tag, text. Doc and tag together tell rows apart; rows with the same of both have the same text.
    """
    dictionary = _phrases(docs, halves=True).groupBy("k1", "k2").agg(
        F.count("*").alias("n"), F.min(F.struct("doc", "tag", "trigger", "first", "last", "before", "after")).alias("p")
    )
    dictionary = written(dictionary.select("k1", "k2", (F.col("n") == 1).alias("once"), "p.*"), "dictionary")
    free_shuffles(docs.sparkSession)
    side = F.explode(F.filter(F.array("before", "after"), lambda k: k.isNotNull()))
    keyed = dictionary.select(side.alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    free_shuffles(docs.sparkSession)
    phrase = ["doc", "tag", "trigger", "first", "last", "once"]
    sided = dictionary.select(*phrase, F.posexplode(F.array("before", "after")).alias("side", "key")).where("key is not null")
    hit = sided.join(shared, "key", "left_semi").groupBy(*phrase)
    wanted = hit.agg(F.max(F.col("side") == 0).alias("before"), F.max(F.col("side") == 1).alias("after"))
    wanted = written(wanted, "wanted")
    free_shuffles(docs.sparkSession)
    contexts = written(_contexts(docs, wanted), "contexts")
    free_shuffles(docs.sparkSession)
    partial = _repeats(contexts, most)
    discard(shared, wanted, contexts)
    free_shuffles(docs.sparkSession)
    whole = _phrases(docs, halves=False).join(dictionary.where("not once").select("k1", "k2"), ["k1", "k2"], "left_semi")
    spans = whole.select("doc", "tag", F.col("first").alias("a"), F.col("last").alias("b")).unionByName(partial)
    spans = written(spans.groupBy("doc", "tag").agg(F.collect_set(F.array("a", "b")).alias("spans")), "spans")
    discard(dictionary, partial)
    free_shuffles(docs.sparkSession)
    return spans


def removed(data: bytes, spans: list[list[int]] | None) -> list[tuple[int, int]]:
    """Maximal runs [from, to) of bytes that strings starting in the spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans or []):
        a, b = a, min(b + LENGTH, len(data))
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _identity() -> tuple[Column, Column]:
    """What tells a row apart: 96 bits of hashes of doc_id and text, so that neither equal nor missing ids join different texts."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text"), F.hash("text", F.col("doc_id").cast("long"))


def _keyed(docs: DataFrame) -> DataFrame:
    doc, tag = _identity()
    return docs.where("text is not null").select(doc.alias("doc"), tag.alias("tag"), "text")


def _with_spans(docs: DataFrame) -> DataFrame:
    spans = covered(_keyed(docs)).select(F.col("doc").alias("_doc"), F.col("tag").alias("_tag"), F.col("spans").alias("_spans"))
    doc, tag = _identity()
    return docs.drop("_spans").join(spans, (doc == F.col("_doc")) & (tag == F.col("_tag")), "left").drop("_doc", "_tag")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs.

    Null and empty texts have no bytes. Every row is a document: rows that repeat remove each other's strings as any two
    documents do. Rows are told apart by id and text together: what a row loses stands in it and elsewhere, whatever ids
    are missing or equal. Other columns aren't read.
    """
    rows = _with_spans(docs.select(F.col("doc_id").cast("long"), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                out = []
                for doc, text, spans in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", "_spans")], strict=True):
                    data, digest, at = _bytes(text), hashlib.sha256(), 0
                    gone = removed(data, spans)
                    for x, y in gone:
                        digest.update(data[at:x])
                        at = y
                    digest.update(data[at:])
                    out.append((doc, len(data), sum(y - x for x, y in gone), len(gone), digest.hexdigest()))
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = (*[pa.int64()] * 4, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_arrow(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with text without its repeated strings, columns as they are. Bytes left of a cut character are dropped.

    As in measure(); documents that nothing is left of stay, with an empty text; null texts stay null.
    """
    rows = _with_spans(packed(docs, "doc_id", "text"))
    at = rows.schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                texts = []
                for text, spans in zip(b.column("text").to_pylist(), b.column("_spans").to_pylist(), strict=True):
                    if text is not None and spans:
                        data, kept, last = _bytes(text), [], 0
                        for x, y in removed(data, spans):
                            kept.append(data[last:x].decode("utf-8", "ignore"))
                            last = y
                        text = "".join([*kept, data[last:].decode("utf-8", "ignore")])
                    texts.append(text)
                columns = list(b.columns)
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return unpacked(map_arrow(rows, run, ddl(rows)).drop("_spans"), docs)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
w AS (SELECT doc_id, i, hash(substring(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 199, 0))) AS i FROM b)),
r AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
s AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
z AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY doc_id, run),
p AS (SELECT z.doc_id, a, z, substring(h, 2 * coalesce(lag(z) OVER (PARTITION BY z.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(z) OVER (PARTITION BY z.doc_id ORDER BY a), 0))) AS kept
  FROM z JOIN b USING (doc_id)),
o AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS gone, count(*) AS runs, max(z) AS last, string_agg(kept, '' ORDER BY a) AS kept FROM p GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(runs, 0) AS n_spans,
  sha256(unhex(CASE WHEN gone IS NULL THEN h ELSE kept || substring(h, 2 * last + 1) END)) AS kept_sha256 FROM b LEFT JOIN o USING (doc_id)
"""
