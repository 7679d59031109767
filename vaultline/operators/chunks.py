"""Chunk stores: splitting, deduplication, reference chains, rebuilding, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialised


def split(files: DataFrame, content: str, size: int = 512) -> DataFrame:
    """files with seq, chunk: pieces of `size` characters or bytes; an empty or null content has none."""
    n = F.ceil(F.length(content) / size).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cut = lambda c: F.transform(places, lambda i: F.substring(c, i * size + 1, F.lit(size)))  # noqa: E731  rows carry a piece each, never the whole
    pieces = F.transform(F.array(content), cut)[0]  # bound once: a cast inside `content` would copy the whole for each piece
    others = [c for c in files.columns if c != content]
    return files.select(*others, F.posexplode(pieces).alias("seq", "chunk"))


def canonical(chunks: DataFrame, digest: str, place: str) -> DataFrame:
    """digest, canonical (its smallest place), refs (how often it occurs)."""
    return chunks.groupBy(digest).agg(F.min(place).alias("canonical"), F.count("*").alias("refs"))


def follow(records: DataFrame, most: int = 16) -> DataFrame:
    """key, target, hops, error for records (key, cite): cite is null for direct records.

    A key's target is the direct record at the end of its chain. More than `most` hops is an error (`cite loop`), and so is a
    record that is not there (`missing`). Chains double with each round, so that five joins reach beyond 16 hops.
    """
    step = materialised(records.select("key", F.coalesce("cite", "key").alias("at"), F.when(F.col("cite").isNull(), 0).otherwise(1).alias("hops")), "cites")
    reach = 1
    while reach <= most:
        ahead = step.select(F.col("key").alias("at"), F.col("at").alias("next"), F.col("hops").alias("more"))
        met = step.join(ahead, "at", "left")
        step = met.select("key", F.coalesce("next", "at").alias("at"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))
        step = materialised(step, "cites")
        reach *= 2
    direct = records.where("cite is null").select(F.col("key").alias("at"), F.lit(True).alias("direct"))
    known = records.select(F.col("key").alias("at"), F.lit(True).alias("known"))
    out = step.join(known, "at", "left").join(direct, "at", "left")
    error = F.when((F.col("hops") > most) | (F.col("known") & F.col("direct").isNull()), "cite loop").when(F.col("known").isNull(), "missing")
    return out.select("key", F.when(error.isNull(), F.col("at")).alias("target"), F.when(error.isNull(), F.col("hops")).alias("hops"), error.alias("error"))


def needed(chunks: DataFrame, file: str, size: str, length: str) -> DataFrame:
    """chunks (file, seq, length, size) with cum, needed, exact: keys are used until the bytes reach the file's size.

    exact is false for a file whose chunks end short of its size or overshoot it.
    """
    w = Window.partitionBy(file)
    cum = F.sum(length).over(w.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = chunks.withColumn("cum", cum.cast("long"))
    rows = rows.withColumn("needed", F.col("cum") - F.col(length) < F.col(size))
    return rows.withColumn("exact", F.coalesce(F.max(F.when(F.col("needed"), F.col("cum"))).over(w) == F.col(size), F.col(size) == 0))


def rebuilt(parts: DataFrame, file: str, chunk: str) -> DataFrame:
    """file, content: the chunks of each file in order of seq. For contents of moderate size; a file is one row."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.col(chunk).alias("data"))))
    return parts.groupBy(file).agg(F.array_join(F.transform(ordered, lambda x: x.data), "").alias("content"))


def first_key(chunks: DataFrame, attempts: list, digest: str, name: str = "key") -> DataFrame:
    """chunks with name: the number of the first attempt (digest columns in order of preference) equal to digest, or null."""
    out = F.lit(None).cast("int")
    for i, attempt in reversed(list(enumerate(attempts))):
        out = F.when(attempt == F.col(digest), i).otherwise(out)
    return chunks.withColumn(name, out)


def shard_layout(shards: DataFrame, size: int) -> DataFrame:
    """shards (family, n) with start (from the number, so that gaps stay gaps), next, gap (numbers missing before next)."""
    following = F.lead("n").over(Window.partitionBy("family").orderBy("n"))
    rows = shards.withColumn("start", (F.col("n") * size).cast("long")).withColumn("next", following)
    return rows.withColumn("gap", F.coalesce(F.col("next") - F.col("n") - 1, F.lit(0)))


def readable(reads: DataFrame, shards: DataFrame, size: int) -> DataFrame:
    """reads (read, family, off, len) with got: the bytes up to the first hole, short shard or end. shards: family, n, bytes.

    A read names the shards that it touches, which meet on equality; bytes count only while every earlier shard is whole.
    """
    last = F.floor((F.col("off") + F.col("len") - 1) / size).cast("long")
    touched = reads.where("len > 0").withColumn("n", F.explode(F.sequence(F.floor(F.col("off") / size).cast("long"), last)))
    met = touched.join(shards, ["family", "n"], "left")
    a = F.greatest(F.lit(0), F.col("off") - F.col("n") * size)
    want = F.least(F.lit(size), F.col("off") + F.col("len") - F.col("n") * size) - a
    have = F.greatest(F.lit(0), F.least(a + want, F.coalesce("bytes", F.lit(0))) - a)
    met = met.withColumns({"want": want.cast("long"), "have": have.cast("long")})
    w = Window.partitionBy("read").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("open", F.coalesce(F.min((F.col("have") == F.col("want")).cast("int")).over(w), F.lit(1)) == 1)
    got = met.groupBy("read").agg(F.sum(F.when(F.col("open"), F.col("have")).otherwise(0)).alias("got"))
    return reads.join(got, "read", "left").withColumn("got", F.coalesce("got", F.lit(0)).cast("long"))
