"""Best-fit packing of documents into sequences by non-negative least squares over length patterns (operator 2).

Documents become pieces of at most `size` tokens. The histogram of piece lengths, which has `size` entries at any scale, is
all that the plan is made from: patterns of up to three lengths that fill a sequence exactly are enumerated, non-negative
least squares finds how often to repeat each, the repeats are rounded, and what the histogram has left is packed by best fit,
largest piece first, again by pattern and repeat count. The plan is a table of (length, how many of this length come before,
repeats, sequence, offset); pieces find their places in it by their rank among pieces of the same length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder, slices
from .common import map_arrow, table, written

SIZE = 2048
#: The most patterns that are enumerated; triples are thinned out evenly to fit.
MOST_PATTERNS = 12_000


def patterns(hist: np.ndarray, most: int = MOST_PATTERNS, depth: int = 3) -> np.ndarray:
    """Rows of up to depth (two or three) lengths, largest first, that occur in hist (count by length) and sum to its last index.

    All singles and pairs, and triples thinned out evenly so that no more than `most` rows come out. Unused places are 0.
    """
    size = len(hist) - 1
    there = hist > 0
    there[0] = False
    found = [np.array([[size, 0, 0]])] if there[size] else []
    a = np.arange((size + 1) // 2, size)
    a = a[there[a] & there[size - a]]
    found.append(np.stack([a, size - a, np.zeros_like(a)], 1))
    lengths = np.flatnonzero(there[:size])
    triples = []
    for b in lengths if depth > 2 else ():
        c = lengths[lengths <= b]
        a = size - b - c
        ok = a >= b
        a, c = a[ok], c[ok]
        ok = there[a]
        triples.append(np.stack([a[ok], np.full(ok.sum(), b), c[ok]], 1))
    if triples:
        triples = np.concatenate(triples)
        step = max(1, -(-len(triples) // max(1, most - sum(map(len, found)))))
        weight = np.minimum.reduce([hist[triples[:, k]] for k in range(3)])
        order = np.lexsort((*triples.T[::-1], -weight))  # the best stocked first, evenly thereafter
        keep = max(1, most // 2)
        found += [triples[order[:keep]], triples[order[keep:]][::step]]
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def fit_repeats(rows: np.ndarray, hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes sum(x * pattern) close to hist in least squares, by multiplicative updates."""
    h = hist.astype(float).copy()
    h[0] = 0

    def forward(x: np.ndarray) -> np.ndarray:
        y = sum(np.bincount(rows[:, k], x, len(h)) for k in range(rows.shape[1]))
        y[0] = 0
        return y

    back = lambda y: sum(y[rows[:, k]] for k in range(rows.shape[1]))
    x = np.minimum.reduce([np.where(rows[:, k] > 0, h[rows[:, k]], np.inf) for k in range(rows.shape[1])])
    x = x / np.maximum(1, np.bincount(rows[:, 0], minlength=len(h))[rows[:, 0]])
    top = back(h)
    for _ in range(rounds):
        x = x * top / np.maximum(back(forward(x)), 1e-12)
    return x


def plan(hist: np.ndarray, most: int = MOST_PATTERNS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats) that use up hist exactly; hist[n] is the number of pieces of n tokens.

    Fitted twice, with patterns of up to two and of up to three lengths; the plan with fewer sequences is taken.
    """
    return min((_plan(hist, most, depth) for depth in (3, 2)), key=lambda p: sum(n for _, n in p))


def _plan(hist: np.ndarray, most: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    size, left = len(hist) - 1, hist.astype(np.int64).copy()
    left[0], out = 0, []
    rows = patterns(left, most, depth)
    if len(rows):
        x = fit_repeats(rows, left)
        for i in np.argsort(-x, kind="stable"):
            want = int(np.rint(x[i]))
            if want < 1:
                break
            lengths, times = np.unique(rows[i][rows[i] > 0], return_counts=True)
            n = min(want, int((left[lengths] // times).min()))
            if n > 0:
                left[lengths] -= n * times
                out.append((tuple(int(v) for v in sorted(rows[i][rows[i] > 0], reverse=True)), n))
    while left.any():
        # best fit, largest first: fill one sequence, then repeat it while the stock lasts
        room, chosen, stock = size, [], left.copy()
        while True:
            fits = np.flatnonzero(stock[: room + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            chosen.append(n)
            stock[n] -= 1
            room -= n
        lengths, times = np.unique(chosen, return_counts=True)
        n = int((left[lengths] // times).min())
        left[lengths] -= n * times
        out.append((tuple(chosen), n))
    return out


def pieces(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a document's ids and a closing 0, cut at every `size` ids from its end.

    Ids are those of the tokenizer file without special tokens added; the string of one in a text is that token.
    A null text counts as empty and is the closing 0 alone. Only the first piece of a longer document may be shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for b in slices(whole, "text"):
                out: list[tuple] = []
                for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode([t or "" for t in b.column("text").to_pylist()]), strict=True):
                    ids += b"\0\0\0\0"
                    n = len(ids) // 4
                    cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                    out += [(doc, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        enc.rest()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def _places(made: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """key (length and rank of the first piece), sequence and offset of each slot of the plan, in order of key."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, n in made:
        offset = 0
        for v in lengths:
            rows.append(((v << 44) + used.get(v, 0), sequence, offset))
            used[v] = used.get(v, 0) + n
            offset += v
        sequence += n
    table_ = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table_[:, 0], table_[:, 1], table_[:, 2]


def place(cut: DataFrame, size: int = SIZE, rows_per_group: int = 50_000) -> DataFrame:
    """`cut` (as pieces() gives it, written) with sequence_id and offset: gapless from 0 in each sequence.

    Pieces of one length are interchangeable for the plan. Each needs its rank among them: they are dealt by a hash into
    groups of at most about rows_per_group or a partition's share, ranked in their group, and shifted by the sizes of the groups before, so that a length
    that a third of all pieces have is no single task's. The driver gets a histogram of `size` entries.
    """
    hist = np.zeros(size + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():
        hist[r.length] = r.n
    keys, sequences, offsets = _places(plan(hist))
    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, -(-int(hist.max()) // min(rows_per_group, max(1, int(hist.sum()) // parts))))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)))
    sizes = dealt.groupBy("length", "group").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("length", "group", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "group").orderBy("doc_id", "piece")) - 1
    ranked = dealt.withColumn("own", own).join(before, ["length", "group"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).alias("rank"))
    shared = cut.sparkSession.sparkContext.broadcast((keys, sequences, offsets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequences, offsets = shared.value
        for b in batches:
            at = (b.column("length").to_numpy() << 44) + b.column("rank").to_numpy()
            slot = np.searchsorted(keys, at, "right") - 1
            arrays = [*b.columns[:5], pa.array(sequences[slot] + at - keys[slot]), pa.array(offsets[slot])]
            yield pa.RecordBatch.from_arrays(arrays, [*b.schema.names[:5], "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_arrow(ranked, run, schema)


def pack(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """Pieces of all of `docs` (doc_id, text) with their places in as few sequences of at most `size` tokens as it can.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Repeated rows are packed as often as
    they occur, null ids too; an empty table gives an empty result; other columns are not read.
    """
    return place(written(pieces(docs, path, size), "pieces"), size)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
