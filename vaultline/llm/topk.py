"""Exact top-k search by inner product with multi-resolution segment statistics (operator 1).

A vector is cut into 1, 4 and 16 segments; of each segment the mean and the deviation are kept. Over a segment of n
components, sum(q * x) = n * mean(q) * mean(x) + sum((q - mean(q)) * (x - mean(x))), and the last term is n * dev(q) * dev(x) at
most. Summed over segments this bounds the score from above (the squared distance from below), the tighter the finer the
segments.

Vectors are dealt into cells around pivots, so that a block's vectors are alike, and a block keeps the ranges of its segments'
means and the largest deviations, which bound the scores of all of its vectors at once. Every query gets a first bound of its k-th
best score from a sample, goes only to the blocks whose bound reaches that, and there drops vectors whose own bounds are under
the worst of the k best so far, coarse to fine; only survivors are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, table, written

LEVELS = (1, 4, 16)
NO_BOUND = np.int64(-(2**62))


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component, for every row; rows with the same vec_id stay.

    Null vectors, vectors with null or non-finite components and null ids take no part.
    """
    x = F.col("embedding")
    fine = ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    v = F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("long"))
    return vectors.where(x.isNotNull() & F.col("vec_id").isNotNull()).where(fine).select(F.col("vec_id").cast("long"), v.alias("v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix, short ones filled up with zeros."""
    flat, n = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), width), np.int64)
    out[np.arange(width)[None, :] < n[:, None]] = flat
    return out


def _statistics(x: np.ndarray, parts: int) -> np.ndarray:
    """Means and deviations of `parts` segments, each times the root of its length: bounds are inner products of rows."""
    columns = []
    for s in np.array_split(np.arange(x.shape[1]), parts):
        if len(s):
            mean = x[:, s].mean(axis=1)
            spread = np.sqrt(np.maximum(((x[:, s] - mean[:, None]) ** 2).sum(axis=1), 0))
            columns += [mean * np.sqrt(len(s)), spread]
    return np.stack(columns, axis=1) if columns else np.zeros((len(x), 1))


def _ranges(stats: np.ndarray) -> np.ndarray:
    """Of rows of _statistics(): the least and the largest mean, and the largest deviation, of each segment."""
    return np.concatenate([stats[:, 0::2].min(axis=0), stats[:, 0::2].max(axis=0), stats[:, 1::2].max(axis=0)])


def block_bounds(q_stats: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """The most that each query can score in each block, given the blocks' _ranges() as rows."""
    m = q_stats.shape[1] // 2
    mean, spread = q_stats[:, 0::2], q_stats[:, 1::2]
    low, high, wide = ranges[:, :m], ranges[:, m : 2 * m], ranges[:, 2 * m :]
    positive, negative = np.maximum(mean, 0), np.minimum(mean, 0)
    return positive @ high.T + negative @ low.T + spread @ wide.T


def _slack(q: np.ndarray, largest: float) -> np.ndarray:
    return 1e-9 * (1 + np.sqrt((q**2).sum(axis=1)) * largest)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer rows: by doubles where they are exact, else by integers."""
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1]) < 2**53
    return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if exact else q @ x.T


class Block:
    """Vectors of a block with their statistics: ids and rows in order of id, so that ties go to the smaller one."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, step: int = 1024) -> None:
        order = np.lexsort((rows, ids))
        self.ids, self.rows, self.x, self.step = ids[order], rows[order], x[order], step
        f = self.x.astype(np.float64)
        self.stats = [_statistics(f, n) for n in LEVELS]
        self.largest = float(np.sqrt((f**2).sum(axis=1).max(initial=0)))
        self.scored = 0  # pairs that were scored exactly

    def top_k(self, own: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, id, score) of the k best vectors for each row of q that score floor at least; own: the row that is the query itself."""
        f = q.astype(np.float64)
        stats, slack, worst = [_statistics(f, n) for n in LEVELS], _slack(f, self.largest), floor.astype(np.float64)
        found = [(np.zeros(0, np.int64),) * 3]
        for a in range(0, len(self.x), self.step):
            part = slice(a, min(a + self.step, len(self.x)))
            limit = (worst - slack)[:, None]
            i, j = np.nonzero(stats[0] @ self.stats[0][part].T >= limit)
            for qs, xs in zip(stats[1:], self.stats[1:], strict=True):
                if not len(i):
                    break
                if len(i) * 8 > len(q) * (part.stop - a):  # most pairs are alive: all at once
                    ok = (qs @ xs[part].T)[i, j] >= limit[i, 0]
                else:
                    ok = np.einsum("ij,ij->i", qs[i], xs[part][j]) >= limit[i, 0]
                i, j = i[ok], j[ok]
            ok = own[i] != self.rows[part][j]
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            self.scored += len(i)
            if len(i) * 8 > len(q) * (part.stop - a):
                s = _scores(q, self.x[part])[i, j]
            else:
                s = np.einsum("ij,ij->i", q[i], self.x[part][j])
            ok = s >= worst[i]
            found.append((i[ok], self.ids[part][j[ok]], s[ok]))
            rows, ids, scores = (np.concatenate(z) for z in zip(*found, strict=True))
            order = np.lexsort((ids, -scores, rows))
            rows, ids, scores = rows[order], ids[order], scores[order]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            found = [tuple(z[rank < k] for z in (rows, ids, scores))]
            full = rank == k - 1
            worst[rows[full]] = np.maximum(worst[rows[full]], scores[full])
        return found[0]


def top_k(vectors: DataFrame, asked: Column, k: int = 20, rows_per_block: int = 8192, queries_per_batch: int = 1024, sample: int = 4096, pivots: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `vectors` (vec_id, v array<long>) that is asked for, its k highest inner
    products over all other rows.

    Rows are told apart by a number of their own: rows with one vec_id are candidates each, and queries each. Vectors of
    different lengths meet as if filled up with zeros. Scores are 64-bit integers; ties go to the smaller vec_id. A sample
    of rows, by a hash, gives the first bounds, and its first ones are the pivots, four for each block's worth of rows and `pivots`
    at most; both decide what is looked at, and nothing about the result. A task holds one block, of `rows_per_block` or, beyond
    a thousand blocks for each pivot, a thousandth of its cell; queries stream by. The driver gets the sample and the ranges.
    """
    spark = vectors.sparkSession
    rows = written(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "rows")
    width, n = rows.agg(F.max(F.size("v")), F.count("*")).first()
    width, n_cells = max(1, width or 0), max(1, min(pivots, -(-4 * n // rows_per_block)))
    some = rows.orderBy(F.xxhash64("row"), "row").limit(sample).collect()
    drawn = np.zeros((len(some), width), np.int64)
    for r, target in zip(some, drawn, strict=True):
        target[: len(r.v)] = r.v
    shared = spark.sparkContext.broadcast((np.array([r.row for r in some], np.int64), drawn))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value[1][:n_cells].astype(np.float64)
        size = (centers**2).sum(axis=1)
        for b in batches:
            x = _matrix(b.column("v"), width).astype(np.float64)
            cell = np.argmin(size - 2 * (x @ centers.T), axis=1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], ["row", "vec_id", "v", "cell"])

    cells = map_arrow(rows, celled, "row long, vec_id long, v array<long>, cell int")
    counts = {r.cell: r.n for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    parts = F.array(*[F.lit(min(1000, -(-counts.get(c, 1) // rows_per_block))) for c in range(n_cells)])
    block = F.col("cell") * 1000 + F.pmod(F.xxhash64("row"), F.element_at(parts, F.col("cell") + 1))
    placed = written(cells.select("row", "vec_id", "v", block.cast("int").alias("block")), "placed")

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks, stats = b.column("block").to_numpy(), _statistics(_matrix(b.column("v"), width).astype(np.float64), LEVELS[-1])
            names = np.unique(blocks)
            found = np.array([_ranges(stats[blocks == n]) for n in names]).reshape(len(names), -1)
            at = np.tile(np.arange(found.shape[1], dtype=np.int32), len(names))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, found.shape[1])), pa.array(at), pa.array(found.ravel())], ["block", "i", "x"])

    each = map_arrow(placed.select("block", "v"), ranged, "block int, i int, x double").groupBy("block", "i").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
    names = sorted({r.block for r in each})
    at = {n: i for i, n in enumerate(names)}
    m = max([r.i for r in each], default=-1) + 1
    ranges = np.zeros((len(names), m))
    for r in each:
        ranges[at[r.block], r.i] = r.low if r.i < m // 3 else r.high
    told = spark.sparkContext.broadcast((np.array(names, np.int32), ranges))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with its first bound and the blocks that may hold one of its best."""
        names, ranges = told.value
        own, x = shared.value
        largest = float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
        reach = np.abs(ranges).sum(axis=1).max(initial=0) + largest
        for whole in batches:
            for i in range(0, len(whole), queries_per_batch):
                b = whole.slice(i, queries_per_batch)
                q = _matrix(b.column("v"), width)
                scores = _scores(q, x)
                floor = np.full(len(q), NO_BOUND)
                # the query itself may be among the sample: then the next one counts
                inside = (b.column("row").to_numpy()[:, None] == own[None, :]).any(axis=1)
                for extra in (0, 1):
                    n = k + extra
                    if n <= len(x):
                        best = np.partition(scores, len(x) - n, axis=1)[:, len(x) - n]
                        floor = np.where(inside == bool(extra), best, floor)
                f = q.astype(np.float64)
                alive = block_bounds(_statistics(f, LEVELS[-1]), ranges) >= (floor - _slack(f, reach))[:, None]
                to = [names[row] for row in alive]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(floor), pa.array(to, pa.list_(pa.int32()))], [*b.schema.names, "floor", "to"])

    queries = map_arrow(placed.where(asked).select("row", "vec_id", "v"), sent, "row long, vec_id long, v array<long>, floor long, to array<int>")
    queries = queries.select(F.explode("to").alias("block"), F.lit(1).alias("kind"), "row", "vec_id", "v", "floor")
    both = placed.select("block", F.lit(0).alias("kind"), "row", "vec_id", "v", F.lit(0).cast("long").alias("floor")).unionByName(queries)
    both = both.repartition("block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at, block = None, None
        for whole in batches:
            where = whole.column("block").to_numpy() * 2 + whole.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), len(where)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                for lo in range(i, j, queries_per_batch):
                    b = whole.slice(lo, min(queries_per_batch, j - lo))
                    own, ids, x = b.column("row").to_numpy(), b.column("vec_id").to_numpy(), _matrix(b.column("v"), width)
                    name = b.column("block")[0].as_py()
                    if name != at:
                        held, at, block = [], name, None
                    if not b.column("kind")[0].as_py():
                        held.append((ids, own, x))
                        continue
                    block = block or Block(*[np.concatenate(z) for z in zip(*held, strict=True)])
                    r, found, score = block.top_k(own, x, b.column("floor").to_numpy(), k)
                    yield pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(ids[r]), pa.array(found), pa.array(score)], ["row", "query_id", "vec_id", "score"])

    found = map_arrow(both, run, "row long, query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


OP1_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
