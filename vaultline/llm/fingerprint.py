"""Document fingerprints by locally consistent parsing (operator 3).

A text is a sequence of symbols, at first its code points. On each level equal neighbours become one run; deterministic
coin tossing then relabels every symbol by the lowest bit in which it differs from the one before, until few labels are
left; local maxima of the labels start phrases, and a phrase's name is a hash of its symbols. Names are the next level's
symbols. Where a phrase starts depends on a few symbols around, so equal substrings get equal names inside, at any offset.
A fingerprint holds the smallest hashes of a text's phrase names; likeness is the share that two fingerprints have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import map_arrow, table

#: Hashes in a fingerprint.
SIZE = 64
CHARS = 600_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (multiply, xor, shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """2 k + bit k of each symbol, k the lowest bit in which it differs from the one before; k is 0 at the start of a text."""
    y = np.empty_like(x)
    y[0], y[1:] = 1, x[1:] ^ x[:-1]
    y[first] = 1
    k = np.bitwise_count((y & (~y + x.dtype.type(1))) - x.dtype.type(1)).astype(np.uint8)
    bit = ((x >> k.astype(x.dtype)) & x.dtype.type(1)).astype(np.uint8)
    return 2 * k + bit


def _toss_table() -> np.ndarray:
    """_toss for labels under 128: [label before, label]."""
    out = np.zeros((128, 128), np.uint8)
    for a in range(128):
        for b in range(128):
            k = ((a ^ b) & -(a ^ b)).bit_length() - 1 if a != b else 0
            out[a, b] = 2 * k + (b >> k & 1)
    return out.ravel()


TOSSED = _toss_table()


def _phrases(s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level, and where each text starts in them. first: where each text starts in s; none is empty."""
    new = np.empty(len(s), bool)
    new[0], new[1:] = True, s[1:] != s[:-1]
    new[first] = True
    at = np.flatnonzero(new)
    if len(at) < len(s):
        length = np.diff(np.append(at, len(s))).astype(np.uint64)
        run = s[at]
        long = length > 1
        run[long] = _mix(run[long] + length[long] * np.uint64(0xD6E8FEB86659FD93))
        first = np.searchsorted(at, first)
        s = run
    label = _toss(s, first)
    for _ in range(3):
        before = np.empty(len(s), np.uint16)
        before[0], before[1:] = 0, label[:-1]
        tossed = TOSSED[before * np.uint16(128) + label]
        tossed[first] = label[first] & 1
        label = tossed
    start = np.zeros(len(s), bool)
    start[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    start[first[1:] - 1] = False  # a text's last symbol stays with what is before it
    if len(s) > 1:
        second = first + 1
        start[second[second < len(s)]] = False
    start[first] = True
    at = np.flatnonzero(start)
    inside = (np.arange(len(s)) - np.repeat(at, np.diff(np.append(at, len(s))))).astype(np.uint64)
    names = np.add.reduceat(_mix(s + _mix(inside + np.uint64(1))), at)
    return _mix(names), np.searchsorted(at, first)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """keys in order, each once."""
    keys.sort()
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _smallest(keys: np.ndarray, texts: int) -> np.ndarray:
    """Of keys (text in the upper, hash in the lower half) in order and each once: at least the SIZE smallest of each text, all if fewer.

    Hashes are even, so that those under a bound are about four times as many as asked for, and only they are sorted. A text with
    too few distinct ones under its bound, as repeated names make, is sorted whole.
    """
    of = (keys >> np.uint64(32)).astype(np.int64)
    bound = np.uint64(2**34 * SIZE) // np.maximum(np.bincount(of, minlength=texts), 1).astype(np.uint64)
    low = _distinct(keys[(keys & np.uint64(0xFFFFFFFF)) < bound[of]])
    found = (low >> np.uint64(32)).astype(np.int64)
    short = (np.bincount(found, minlength=texts) < SIZE) & (bound < np.uint64(2**32))
    if short.any():
        low = np.concatenate([low[~short[found]], _distinct(keys[short[of]])])
        low.sort()
    return low


def sketches(texts: list[str]) -> list[np.ndarray]:
    """For each text the SIZE smallest 32-bit hashes of its distinct phrase names of all levels, in order; none for an empty text.

    A text of one symbol has that symbol's name.
    """
    owner = np.array([i for i, t in enumerate(texts) if t], np.int64)
    out = [np.zeros(0, np.uint32)] * len(texts)
    if not len(owner):
        return out
    s = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(texts[i]) for i in owner], np.int64)
    first = np.cumsum(lengths) - lengths
    parts, doc, level = [], owner, 0
    while len(doc):
        count = np.diff(np.append(first, len(s)))
        done = count == 1
        take = np.repeat(done | (level >= 1), count)
        parts.append((np.repeat(doc, count)[take].astype(np.uint64) << np.uint64(32)) | (_mix(s[take]) >> np.uint64(32)))
        if done.any():
            s, doc, count = s[np.repeat(~done, count)], doc[~done], count[~done]
            first = np.cumsum(count) - count
        if len(doc):
            s, first = _phrases(s, first)
        level += 1
    keys = _smallest(np.concatenate(parts), len(texts))
    of = (keys >> np.uint64(32)).astype(np.int64)
    at, h = np.searchsorted(of, np.arange(len(texts) + 1)), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return [h[at[i] : min(at[i + 1], at[i] + SIZE)] for i in range(len(texts))]


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the SIZE smallest hashes of both together that each has; 1 for two empty texts."""
    both = np.concatenate([a, b])
    if not len(both):
        return 1.0
    both.sort()
    twice = both[1:] == both[:-1]
    distinct = np.append(True, ~twice)
    rank = np.cumsum(distinct)
    n = min(SIZE, int(rank[-1]))
    return float(np.count_nonzero(twice & (rank[1:] <= n)) / n)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the text that follows."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def _bucket(key, h, bounds: list[tuple[int, int]], low: int = 0):
    """How many bounds are at most (key, h), by binary search."""
    if not bounds:
        return F.lit(low)
    m = len(bounds) // 2
    k, v = bounds[m]
    before = (key < k) | ((key == k) & (h < v))
    return F.when(before, _bucket(key, h, bounds[:m], low)).otherwise(_bucket(key, h, bounds[m + 1 :], low + m + 1))


def _bounds(quantiles: list[int]) -> list[tuple[int, int]]:
    """Bounds (id, hash) from quantiles of ids: an id that is several of them is cut by the hashes of its texts as often."""
    ids, times = np.unique(np.array(quantiles, np.int64), return_counts=True)
    return [(int(v), -(2**63) + 2**64 * i // n) for v, n in zip(ids.tolist(), times.tolist(), strict=True) for i in range(n)]


def in_order(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(bucket, tail, doc_id, text), each bucket in one partition and in order, with one shuffle of the texts.

    Order: doc_id, nulls first, then a hash of the text. Buckets are ranges of both, four for each shuffle partition, so that
    an id that many rows share, or none, is spread by its texts. After its own rows (tail 0) a bucket holds the smallest of the next
    bucket again (tail 1), the last bucket those of the first; so each row's follower stands beside it. The driver gets one
    bound and one smallest row's id and hash for each bucket.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = buckets or 4 * parts
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    text = F.coalesce("text", F.lit(""))
    quantiles = F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n) if n > 1 else F.lit(None)
    bounds = _bounds(docs.agg(quantiles).first()[0] or [])
    rows = docs.select(key.alias("key"), F.xxhash64(text).alias("h"), F.col("doc_id").cast("long"), text.alias("text"))
    rows = rows.withColumn("b", _bucket(F.col("key"), F.col("h"), bounds))
    least = {r.b: (r.k.key, r.k.h) for r in rows.groupBy("b").agg(F.min(F.struct("key", "h")).alias("k")).collect()}
    filled = sorted(least)
    before = {b: filled[i - 1] for i, b in enumerate(filled)}
    size = range(len(bounds) + 1)
    kind = lambda values, name: F.element_at(F.array(*[F.lit(v).cast(name) for v in values]), F.col("b") + 1)
    own = F.struct(F.col("b").cast("int").alias("bucket"), F.lit(0).alias("tail"))
    copy = F.struct(kind([before.get(b, 0) for b in size], "int").alias("bucket"), F.lit(1).alias("tail"))
    first = (kind([least.get(b, (None, None))[0] for b in size], "long") == F.col("key")) & (kind([least.get(b, (None, None))[1] for b in size], "long") == F.col("h"))
    rows = rows.select(F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own))).alias("p"), "key", "h", "doc_id", "text")
    dealt = rows.select("p.bucket", "p.tail", "key", "h", "doc_id", "text").repartition(parts, "bucket")
    return dealt.sortWithinPartitions("bucket", "tail", "key", "h", "text").select("bucket", "tail", "doc_id", "text")


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of whole texts, of their edited texts, and likeness to those and to the next document's.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row. Null texts
    are empty, with an empty fingerprint. Rows of one doc_id, and those without, follow each other in order of a hash of the text; the
    last row is followed by the first; a single row by itself. Other columns are not read. Equal texts have equal fingerprints.
    """
    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row: its follower is in the next batch
        for whole in batches:
            for b in slices(whole, "text", CHARS):
                rows = held + list(zip(*[b.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text")], strict=True))
                held = rows[-1:]
                pairs = [i for i in range(len(rows) - 1) if not rows[i][1]]
                texts = [r[3] for r in rows]
                changed = [edited(texts[i], texts[i + 1]) for i in pairs]
                own, other = sketches(texts), sketches(changed)
                yield pa.RecordBatch.from_arrays([
                    pa.array([rows[i][2] for i in pairs], pa.int64()),
                    pa.array([len(texts[i]) for i in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                    pa.array([as_text(own[i]) for i in pairs], pa.string()),
                    pa.array([as_text(e) for e in other], pa.string()),
                    pa.array([likeness(own[i], e) for i, e in zip(pairs, other, strict=True)], pa.float64()),
                    pa.array([likeness(own[i], own[i + 1]) for i in pairs], pa.float64()),
                ], names)

    return map_arrow(in_order(docs), run, out)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))
