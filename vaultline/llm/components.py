"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (src, dst: any sortable type); component is the smallest node.

    Each round links a node's larger neighbours to its smallest one (large star), then its smaller neighbours to
    the smallest one (small star), until nothing changes; rounds grow with the logarithm of the largest component.
    A node with very many neighbours costs one aggregated minimum, not a collected list. Self loops and repeated
    edges are harmless, null ends are dropped, an empty table gives an empty result. Raises if max_rounds is hit.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    e = written(e.where("u is not null and v is not null and u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("lo")).select("u", F.least("u", "lo").alias("lo"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("lo").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("lo"))
        joined = large.join(low, "u")
        small = joined.where("v <> lo").select(F.col("v").alias("u"), F.col("lo").alias("v"))
        small = small.unionByName(low.select("u", F.col("lo").alias("v"))).distinct()
        e, last = written(small, "edges"), e
        discard(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
