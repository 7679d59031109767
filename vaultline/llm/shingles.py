"""Sets of word shingles, and their exact Jaccard likeness.

A text is the set of its shingles of five words (A-Z in lower case), each a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import LOWER, WORDS, map_arrow

#: Multipliers of a shingle's words.
PLACE = np.random.default_rng(7).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int = 5, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle, one without words none."""
    words = WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    known = {} if known is None else known
    h = xxhash.xxh3_64_intdigest
    for w in set(words):
        if w not in known:
            known[w] = h(w)
    x = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out += mix(x[k : k + len(out)] * PLACE[k])
    return np.unique(mix(out))


def recent(known: dict[bytes, int]) -> dict[bytes, int]:
    """A worker's memory of words, emptied once it is large."""
    if len(known) > 200_000:
        known.clear()
    return known


def shingle_sets(rows: DataFrame, width: int) -> DataFrame:
    """node, items (its shingles) of each row of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for whole in batches:
            for b in slices(whole, "text"):
                sets = [shingles(t, width, recent(known)).view(np.int64) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "items"])

    return map_arrow(rows.select("node", "text"), run, "node long, items array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(src, dst) of those pairs whose sets have this Jaccard likeness at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("x"), b.column("y")
            hit = []
            for i in range(len(b)):
                v, w = (c[i].values.to_numpy() for c in (x, y))
                common = len(np.intersect1d(v, w, assume_unique=True))
                hit.append(common + 1e-9 >= similarity * (len(v) + len(w) - common))
            yield b.select(["src", "dst"]).filter(pa.array(hit, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("dst"), F.col("items").alias("y")), "dst")
    both = both.join(sets.select(F.col("node").alias("src"), F.col("items").alias("x")), "src")
    return map_arrow(both.select("src", "dst", "x", "y"), run, "src long, dst long")
