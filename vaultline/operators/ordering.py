"""Ranks over a whole table without a single task that sees it all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialised


def numbered(df: DataFrame, *order, name: str = "rn") -> DataFrame:
    """`df` with name: 1, 2, ... in the given order.

    Rows are range-partitioned and sorted; a row's number is its place in its partition plus the sizes of those before, which
    is a table of one row for each partition.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.withColumn("_id", F.monotonically_increasing_id())
    placed = placed.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit(2**33 - 1)).alias("_row")).drop("_id")
    placed = materialised(placed, "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(offsets, "_part").withColumn(name, F.col("_row") + F.col("_before") + 1).drop("_part", "_row", "_before")


def worker_blocks(df: DataFrame, workers: int, *order) -> DataFrame:
    """`df` with worker: contiguous blocks of ceil(n / workers) rows in the given order, workers limited to 1 to n."""
    n = df.count()
    per = -(-n // max(1, min(workers, n))) if n else 1
    return numbered(df, *order).withColumn("worker", F.floor((F.col("rn") - 1) / per).cast("int"))


def _in_group(rows: DataFrame, group: list[str]) -> DataFrame:
    """rows of numbered(df, *group, ...) with _i, the place in their group from 0, and _n, the group's size."""
    sizes = rows.groupBy(*group).agg(F.min("rn").alias("_first"), F.count("*").alias("_n"))
    keys = [F.col(f"g.{c}").eqNullSafe(F.col(f"r.{c}")) for c in group]
    met = rows.alias("r").join(sizes.alias("g"), keys)
    return met.select("r.*", (F.col("rn") - F.col("_first")).alias("_i"), "_n")


def slice_sample(df: DataFrame, group: str, order: list[str], k: int, seed: int | None = None) -> DataFrame:
    """One row of each of min(k, n) equal slices [i n // k, (i + 1) n // k) of every group, in order: the middle one, or with a
    seed a pseudo-random one. Rows are numbered over the whole table, so that a large group is no single task's."""
    ranked = _in_group(numbered(df, group, *order), [group]).drop("rn")
    ranked = ranked.withColumn("_k", F.least(F.lit(k), F.col("_n")).cast("long"))
    start = lambda i: F.floor(i * F.col("_n") / F.col("_k")).cast("long")
    ranked = ranked.withColumn("slice", F.floor(((F.col("_i") + 1) * F.col("_k") - 1) / F.col("_n")).cast("long"))
    a, b = start(F.col("slice")), start(F.col("slice") + 1)
    pick = a + F.floor((b - a) / 2) if seed is None else a + F.pmod(F.xxhash64(F.lit(seed), group, "slice"), b - a)
    return ranked.where(F.col("_i") == pick).drop("_n", "_i", "_k")


def run_lengths(df: DataFrame, group: list[str], order: list[str], hit: str) -> DataFrame:
    """Maximal runs of consecutive rows with hit, per group: (group, start, length), start counted from 0.

    Along a run, a row's number among all rows and its number among the hits grow alike; their difference names the run. Both
    are numbers over the whole table, so that a large group is no single task's.
    """
    rows = _in_group(numbered(df, *group, *order), group)
    own = numbered(rows.where(F.col(hit)), *group, *order, name="_hit").withColumn("_run", F.col("rn") - F.col("_hit"))
    return own.groupBy(*group, "_run").agg(F.min("_i").alias("start"), F.count("*").alias("length")).drop("_run")
