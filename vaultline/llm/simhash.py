"""SimHash near-dedup by Golay-code fuzzy hashing (operator 10).

A fingerprint has 64 bits, cut into three segments of 22, 21 and 21. The perfect binary Golay code [23, 12, 7] decodes
any 23 bits to the one codeword at distance 3 or less. A segment's keys are its own codeword's index and, where it lies
at distance 3, those of the five codewords at distance 4: two segments that differ in at most two bits then have a key
in common. Of four differing bits over three segments, at most one segment holds three or more, so that two segments
share a key each: a pair of segments with a key of each is a join key of 24 bits, and no link within four bits is lost.

Texts whose shingle sets have a Jaccard likeness of 0.8 differ in 15 of 100 bits, which no 64 bits can tell from chance.
near_copies() therefore takes a wider fingerprint of sixteen segments of 23 bits, whose pairs are eight join keys; a segment
of two such texts shares a Golay key in six of ten cases. Candidates are held against both whole fingerprints, and what is
left against the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import LOWER, WORDS, discard, free_shuffles, map_arrow, packed, table, unpacked, written
from .components import connected_components
from .shingles import mix, recent, shingle_sets, shingles, verified

#: Generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, and its lengths.
GENERATOR, N_BITS, DATA_BITS = 0b110001110101, 23, 12
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The wide fingerprint: tables of two segments, in words of 64 bits.
TABLES = 8
WIDE = 2 * TABLES * N_BITS
LANES = -(-WIDE // 64)
TIMES = np.random.default_rng(23).integers(0, 2**63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The most bits that candidates may differ in: of the first 64, and of all. At a likeness of 0.8 they differ in 9.7 (deviation
#: 2.9) and 55.9 (6.9).
LOOSE, CLOSE = 21, 73


def fingerprint(text: str | None, width: int = 4) -> int:
    """Bit i is 1 if it is set in over half the XXH64 (seed 42) of the word shingles; no word at all gives 0."""
    words = WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    last = ends[len(words) - n :].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], 42) for a, b in zip(first, last, strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        bits = np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(((2 * counts > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long. Null texts count as empty; rows stay one for one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of each bit, key offsets of each syndrome). Offsets: XOR to the systematic index; column 0 is the own one."""
    def rest(x: int) -> int:
        for i in range(N_BITS - 1, N_BITS - DATA_BITS - 1, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - (N_BITS - DATA_BITS))
        return x

    column = np.array([rest(1 << i) for i in range(N_BITS)], np.int64)
    low = N_BITS - DATA_BITS
    words = [(d << low) | rest(d << low) for d in range(1 << DATA_BITS)]
    sevens = [w for w in words if w.bit_count() == 7]
    by_triple: dict[int, list[int]] = {}
    for w in sevens:
        at = [i for i in range(N_BITS) if w >> i & 1]
        for t in combinations(at, 3):
            by_triple.setdefault(sum(1 << i for i in t), []).append(w)
    offsets = np.zeros((1 << low, 6), np.int64)
    for weight in range(4):
        for t in combinations(range(N_BITS), weight):
            error = sum(1 << i for i in t)
            own = error >> low  # the codeword is x ^ error: its index is that of x, corrected
            syndrome = int(np.bitwise_xor.reduce(column[list(t)])) if t else 0
            near = [w >> low for w in by_triple.get(error, [])]
            offsets[syndrome] = [own, *[own ^ k for k in near], *[own] * (5 - len(near))]
    return column, offsets


def segment_keys(segments: np.ndarray) -> np.ndarray:
    """Up to six codeword indices for each 23-bit word; fewer are filled up with the first."""
    column, offsets = golay()
    syndrome = np.zeros(len(segments), np.int64)
    for i in range(N_BITS):
        syndrome ^= np.where(segments >> i & 1, column[i], 0)
    return (segments >> (N_BITS - DATA_BITS))[:, None] ^ offsets[syndrome]


def join_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all distinct keys of 64-bit fingerprints: 2 bits for the pair of segments, 12 for each index."""
    u = fps.view(np.uint64)
    return _paired([((u >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS], ((0, 1), (0, 2), (1, 2)))


def _paired(segments: list[np.ndarray], pairs) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all distinct keys of pairs of segments: the pair's number and 12 bits for each index."""
    keys = [segment_keys(s) for s in segments]
    rows, found = [], []
    for k, (i, j) in enumerate(pairs):
        both = (k << 24) | (keys[i][:, :, None] << 12) | keys[j][:, None, :]
        both = np.sort(both.reshape(len(both), -1), axis=1)
        new = np.ones(both.shape, bool)
        new[:, 1:] = both[:, 1:] != both[:, :-1]
        rows.append(np.nonzero(new)[0])
        found.append(both[new])
    return np.concatenate(rows), np.concatenate(found)


def fuzzy_keys(distinct: DataFrame) -> DataFrame:
    """(fp, key) for each fingerprint of `distinct`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 4096):
                fps = whole.slice(i, 4096).column("fp").to_numpy(zero_copy_only=False)
                row, key = join_keys(fps)
                yield pa.RecordBatch.from_arrays([pa.array(fps[row]), pa.array(key.astype(np.int32))], ["fp", "key"])

    return map_arrow(distinct.select("fp"), run, "fp long, key int")


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect distinct fingerprints as all their links within the radius do; fewer than there are fingerprints."""
    rest, edges = fps.view(np.uint64), []
    while len(rest) > 1:
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            x = stack.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                edges += [(x, y) for y in found]
                stack += list(found)
    return edges


def _edges(pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.array(x, np.uint64).view(np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
    return np.minimum(a, b), np.maximum(a, b)


def links(distinct: DataFrame, radius: int = 4, few: int = 8, most: int = 20_000, sample: int = 16) -> DataFrame:
    """Edges (src < dst) between different fingerprints at most `radius` (up to 4, which the keys guarantee) bits apart.

    Every bucket gives edges that connect what its links connect, not all of its pairs: buckets of up to `few` fingerprints
    are compared as a whole, larger ones searched breadth first. Buckets of over `most`, as one in `sample` fingerprints tells,
    never meet in one task, but are dealt into blocks by a hash, of which every two are searched together. Either way gives the
    same components: the sample decides on the work's division alone, and no link is lost to size.
    """
    if not 0 <= radius <= 4:
        raise ValueError("radius must be 0 to 4")
    keyed = fuzzy_keys(distinct)
    some = fuzzy_keys(distinct.where(F.pmod(F.xxhash64("fp"), F.lit(sample)) == 0))
    hot = some.groupBy("key").agg((F.count("*") * sample).alias("n")).where(F.col("n") > most)
    hot = written(hot, "hot")

    def batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])

    def whole(fps: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Edges of whole buckets, in order of key and fingerprint."""
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(at, len(fps)))
        inside = np.repeat(size <= few, size)
        f, k = fps[inside], keys[inside]
        for d in range(1, min(few, len(f))):
            hit = (k[d:] == k[:-d]) & (np.bitwise_count((f[d:] ^ f[:-d]).view(np.uint64)) <= radius)
            if hit.any():
                yield batch(f[:-d][hit], f[d:][hit])
        for i, n in zip(at[size > few].tolist(), size[size > few].tolist(), strict=True):
            if edges := forest(fps[i : i + n], radius):
                yield batch(*_edges(edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_f, held_k = np.zeros(0, np.int64), np.zeros(0, np.int32)  # the last bucket may go on in the next batch
        for b in batches:
            fps = np.concatenate([held_f, b.column("fp").to_numpy()])
            keys = np.concatenate([held_k, b.column("key").to_numpy()])
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if last:
                yield from whole(fps[:last], keys[:last])
            held_f, held_k = fps[last:], keys[last:]
        if len(held_f):
            yield from whole(held_f, held_k)

    none_hot = hot.isEmpty()
    cold = keyed if none_hot else keyed.join(hot, "key", "left_anti").select("fp", "key")
    edges = map_arrow(cold.repartition("key").sortWithinPartitions("key", "fp"), run, "src long, dst long")
    if none_hot:
        return edges
    blocks = F.ceil(F.col("n") * 2 / most).cast("int")
    big = keyed.join(hot, "key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = big.withColumn("other", other).select("key", "fp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def two(t: pa.Table) -> pa.Table:
        a, b = _edges(forest(np.unique(t.column("fp").to_numpy()), radius))
        return pa.table({"src": a, "dst": b})

    return edges.unionByName(pairs.groupBy("key", "i", "j").applyInArrow(two, "src long, dst long"))


def groups(docs: DataFrame, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id for every row of `docs`: the smallest doc_id that links reach, itself included.

    Equal fingerprints are one node, however many documents have them; keys, links and components are those of
    distinct fingerprints. Null and empty texts have fingerprint 0 and link like any other. Null ids are kept, and
    don't count as smallest unless a component has no other. Repeated rows and equal ids are kept.
    """
    fps = written(fingerprints(docs), "fps")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    distinct = written(distinct, "distinct")
    linked = written(links(distinct, radius), "linked")
    comp = connected_components(linked)
    named = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = written(named, "named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_fp = written(named.join(least, "component").select("fp", "component_id"), "component_of")
    discard(distinct, linked, named)
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """WIDE bits, as LANES words, of a set of 64-bit shingle hashes: 1 where over half of the shingles have it."""
    counts = np.zeros(64 * LANES, np.int64)
    for i in range(0, len(found), 255):
        words = mix(found[i : i + 255, None] * TIMES[None, :])
        bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    ones = 2 * counts > len(found)
    ones[WIDE:] = False
    return np.packbits(ones, bitorder="little").view(np.uint64)


def wide_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all distinct keys of wide fingerprints, rows of LANES words."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")[:, :WIDE]
    segments = bits.reshape(len(fps), 2 * TABLES, N_BITS) @ (1 << np.arange(N_BITS, dtype=np.int64))
    return _paired(list(segments.T), [(2 * t, 2 * t + 1) for t in range(TABLES)])


BITS = [f"b{i}" for i in range(LANES)]


def sketches(rows: DataFrame, width: int) -> DataFrame:
    """row, hash (128 bits of the set), n (its size), b0, b1, ... (its wide fingerprint) of each row of (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for whole in batches:
            for b in slices(whole, "text"):
                sets = [shingles(t, width, recent(known)) for t in b.column("text").to_pylist()]
                fps = np.array([wide_fingerprint(s) for s in sets]).reshape(-1, LANES).view(np.int64)
                digest = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                columns = [b.column("row"), digest, pa.array([len(s) for s in sets], pa.int64()), *[pa.array(np.ascontiguousarray(c)) for c in fps.T]]
                yield pa.RecordBatch.from_arrays(columns, ["row", "hash", "n", *BITS])

    return map_arrow(rows.select("row", "text"), run, "row long, hash binary, n long, " + ", ".join(f"{c} long" for c in BITS))


def _fit(n, m, similarity: float):
    """Whether sets of these sizes can be as alike as that."""
    return np.minimum(n, m) + 1e-6 >= similarity * np.maximum(n, m)


def wide_members(nodes: DataFrame) -> DataFrame:
    """key, node, n, low (64 bits of the fingerprint) for each key of nodes (node, n, b0, b1, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 2048):
                b = whole.slice(i, 2048)
                fps = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in BITS], axis=1)
                row, key = wide_keys(fps)
                own = [pa.array(b.column("node").to_numpy()[row]), pa.array(b.column("n").to_numpy()[row].astype(np.int32)), pa.array(fps[row, 0])]
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), *own], ["key", "node", "n", "low"])

    return map_arrow(nodes.select("node", "n", *BITS), run, "key int, node long, n int, low long")


def bucket_pairs(members: DataFrame, similarity: float, few: int) -> DataFrame:
    """(key, src, dst, d) from members in order of key: what differs in LOOSE of the first 64 bits at most, without a key, for
    buckets of up to `few`; of larger ones the key and each member with the bucket's first one, however far (d is 64 if it doesn't fit).

    A bucket is read once, whatever its size, and only its first members are held.
    """
    names = ["key", "src", "dst", "d"]

    def far(n, m, a, b) -> np.ndarray:
        return np.where(_fit(n, m, similarity), np.bitwise_count(a ^ b), 64).astype(np.int32)

    def batch(key, src, dst, d) -> pa.RecordBatch:
        keys = pa.nulls(len(src), pa.int32()) if key is None else pa.array(key)
        return pa.RecordBatch.from_arrays([keys, pa.array(src), pa.array(dst), pa.array(d)], names)

    def small(k, node, n, low) -> Iterator[pa.RecordBatch]:
        for s in range(1, min(few, len(k))):
            d = far(n[s:], n[:-s], low[s:], low[:-s])
            hit = (k[s:] == k[:-s]) & (d <= LOOSE)
            if hit.any():
                yield batch(None, node[s:][hit], node[:-s][hit], d[hit])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, None  # the last bucket while it is small, and the first member of the large bucket that may go on
        for b in batches:
            cols = [b.column("key").to_numpy(), b.column("node").to_numpy(), b.column("n").to_numpy(), b.column("low").to_numpy().view(np.uint64)]
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            held = None
            if not len(cols[0]):
                continue
            at = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))
            size = np.diff(np.append(at, len(cols[0])))
            large = size > few
            start = [c[at] for c in cols]
            if first is not None and first[0] == cols[0][0]:
                large[0] = True
                for c, v in zip(start, first, strict=True):
                    c[0] = v
            if not large[-1]:
                held = [c[at[-1] :].copy() for c in cols]
            inside = np.repeat(~large, size)
            if held is not None:
                inside[at[-1] :] = False
            yield from small(*[c[inside] for c in cols])
            out = np.repeat(large, size)
            if out.any():
                k, node, n, low = (c[out] for c in cols)
                _, center, m, other = (np.repeat(c[large], size[large]) for c in start)
                yield batch(k, node, center, far(n, m, low, other))
            first = [c[-1] for c in start] if large[-1] else None
        if held is not None:
            yield from small(*held)

    return map_arrow(members, run, "key int, src long, dst long, d int")


def unlike_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(src, dst) that differ in CLOSE bits at most, in other components, from rows (key, i, j, block, node, component, n, b0, ...)
    in order of key, i and j: all of a unit, if i is j, else those of its two blocks."""

    def pairs(block, node, comp, n, fps) -> Iterator[pa.RecordBatch]:
        kinds, at, count = np.unique(comp, return_inverse=True, return_counts=True)
        most = count.argmax()
        apart = block.min() != block.max()
        rest = np.flatnonzero(at != most)  # pairs have one of these: walk through them, and each meets those of the others that come later
        later = np.ones(len(node), bool)
        src, dst = [], []
        for i in rest:
            later[i] = False
            ok = later & (at != at[i]) & _fit(n, n[i], similarity)
            if apart:
                ok &= block != block[i]
            hit = np.flatnonzero(ok)
            hit = hit[np.bitwise_count(fps[hit] ^ fps[i]).sum(axis=1) <= CLOSE]
            src.append(np.full(len(hit), node[i]))
            dst.append(node[hit])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (src, dst))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def unit(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts)
            fps = np.stack([t.column(c).to_numpy() for c in BITS], axis=1).view(np.uint64)
            yield from pairs(*[t.column(c).to_numpy() for c in ("block", "node", "component", "n")], fps)

        for b in batches:
            if not len(b):
                continue
            k, i, j = (b.column(c).to_numpy() for c in ("key", "i", "j"))
            at = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            if held and tuple(held[-1].column(c)[0].as_py() for c in ("key", "i", "j")) != (k[0], i[0], j[0]):
                yield from unit(held)
                held = []
            for x, y in zip(at, [*at[1:], len(b)], strict=True):
                if x and held:
                    yield from unit(held)
                    held = []
                held.append(b.slice(x, y - x))
        if held:
            yield from unit(held)

    return map_arrow(rows, run, "src long, dst long")


def _linked(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Of pairs (src, dst) of nodes those within CLOSE bits whose sets are as alike as that, written."""
    side = lambda own, to: nodes.select(F.col("node").alias(own), *[F.col(c).alias(f"{to}{c}") for c in BITS])
    both = pairs.join(side("src", "x"), "src").join(side("dst", "y"), "dst")
    differ = sum(F.bit_count(F.col(f"x{c}").bitwiseXOR(F.col(f"y{c}"))) for c in BITS)
    close = written(both.where(differ <= CLOSE).select("src", "dst"), "close")
    free_shuffles(rows.sparkSession)
    ends = close.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    texts = rows.select(F.col("row").alias("node"), "text").join(ends, "node")
    sets = written(shingle_sets(texts, width), "sets")
    out = written(verified(close, sets, similarity), "linked")
    discard(close, sets)
    free_shuffles(rows.sparkSession)
    return out


def near_copies(rows: DataFrame, width: int = 5, similarity: float = 0.8, few: int = 8, most: int = 4096) -> DataFrame:
    """(row, component) for every row of (row, text), row being unique: components of the links of at least this likeness.

    Null texts count as empty; texts without words are one component; equal sets of shingles are one node. Pairs in a bucket of up
    to `few` are candidates; of larger ones, at first each member with the closest of the first members of its buckets, which joins
    large groups of copies at a cost linear in their size. Then, bucket by bucket, all pairs that aren't in one component yet:
    however large a bucket is, no pair that could join components is left out. Buckets of over `most` are dealt into blocks of
    that size, of which every two meet. Links are verified on whole sets; of pairs at exactly 0.8 about 97 % share a bucket, and
    of those at 0.85 99 %.
    """
    spark = rows.sparkSession
    made = written(sketches(rows, width), "sketches")
    one = made.groupBy("hash").agg(F.min("row").alias("node"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in BITS])
    nodes = written(one, "nodes")
    free_shuffles(spark)
    members = wide_members(nodes.where("n > 0")).repartition("key").sortWithinPartitions("key", F.xxhash64("node", "key"))
    met = written(bucket_pairs(members, similarity, few), "met")
    free_shuffles(spark)
    star = met.where(f"key is not null and src <> dst and d <= {LOOSE}").groupBy("src").agg(F.min(F.struct("d", "dst")).alias("p"))
    pairs = met.where("key is null").select("src", "dst").unionByName(star.select("src", F.col("p.dst").alias("dst")))
    links = _linked(rows, nodes, pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), width, similarity)
    comp = written(connected_components(links), "component_of")
    large = met.where("key is not null").select("key", F.col("src").alias("node"))
    if not large.isEmpty():
        of = large.join(comp, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        of = written(of, "large")
        mixed = of.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
        blocks = F.when(F.col("size") > most, F.ceil(2 * F.col("size") / most)).otherwise(1).cast("int")
        dealt = of.join(mixed.select("key", blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).join(nodes.select("node", "n", *BITS), "node")
        units = dealt.select("key", "i", "j", "block", "node", "component", "n", *BITS).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        more = _linked(rows, nodes, unlike_pairs(units, similarity).distinct(), width, similarity)
        if not more.isEmpty():
            discard(comp)
            comp = written(connected_components(links.unionByName(more)), "component_of")
        discard(of, more)
    discard(met)
    label = made.select("row", "hash").join(nodes.select("hash", "node"), "hash")
    label = written(label.join(comp, "node", "left").select("row", F.coalesce("component", "node").alias("component")), "component_of_row")
    discard(made, nodes, links, comp)
    free_shuffles(spark)
    return label


def numbered_rows(docs: DataFrame) -> DataFrame:
    """row, doc_id, text and the rest of every row of `docs`, written: row tells rows apart that have no id, or the same one."""
    rows = packed(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "text")
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "rows")


def first_rows(rows: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of numbered_rows() that come first in their component, by doc_id (null last), text and row; label: (row, component)."""
    of = written(label.join(rows.select("row", "doc_id"), "row"), "labels")
    best = of.groupBy("component").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id")).alias("best"))
    tied = of.join(best, "component").where(F.col("doc_id").eqNullSafe(F.col("best.doc_id"))).select("component", "row")
    tied = written(tied, "tied")
    n = tied.groupBy("component").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    n = written(n, "first")
    keep = n.where("n = 1").select("row")
    if not n.where("n > 1").isEmpty():
        several = tied.join(n.where("n > 1").select("component"), "component").join(rows.select("row", "text"), "row")
        several = several.groupBy("component").agg(F.min(F.struct(F.isnull("text").alias("none"), "text", "row")).alias("first"))
        keep = keep.unionByName(several.select(F.col("first.row").alias("row")))
    return rows.join(keep, "row")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id; columns stay as they are.

    Near copies are what links of at least this Jaccard likeness of `width`-word shingles connect, as near_copies() finds them.
    Rows are told apart by a number of their own, not by doc_id: rows without an id, or with the same one, are documents like
    others. Of a group's rows that repeat the smallest id, the first in order of text stays. A row without an id stays where no
    row of its group has one, and only the first in order of text does.
    """
    rows = numbered_rows(docs)
    label = near_copies(rows.select("row", "text"), width, similarity)
    return unpacked(first_rows(rows, label).drop("row"), docs)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
