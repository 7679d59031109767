"""Hierarchies held as (id, parent, name, ...) rows: paths, ancestors, subtree totals, pruning, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.expr import is_sidecar
from ..sources.storage import materialised


def _rooted(dirs: DataFrame, root) -> DataFrame:
    """dirs with the parent of rows whose own one is missing, or is the row itself, replaced by root (null: they are roots)."""
    known = dirs.select(F.col("id").alias("parent"), F.lit(True).alias("known")).distinct()
    rows = dirs.join(known, "parent", "left")
    own = F.when(F.col("known") & (F.col("parent") != F.col("id")), F.col("parent"))
    lost = F.col("parent").isNotNull() & (F.col("id") != F.lit(root)) if root is not None else F.lit(False)
    return rows.select("id", F.coalesce(own, F.when(lost, F.lit(root))).alias("parent"), "name")


def directories(dirs: DataFrame, root=None) -> DataFrame:
    """id, path, ancestors (root first, itself last), pruned for directories (id, parent, name).

    Roots have a null parent. Rows whose parent is missing, or is the row itself, hang under `root`, or are roots themselves if
    none is named. Every round joins each directory's known chain with the chain of its highest known ancestor, so
    that chains double: a tree of depth 1000 takes ten joins, and as many rounds are made as the tree needs. Each round finishes
    some directory as long as any leads to a root; what is left then hangs on a cycle, which no root reaches, and is left out.
    pruned: itself or an ancestor is a side file.
    """
    chain = _rooted(dirs, root).select(
        "id", F.col("parent").alias("up"), F.concat(F.lit("/"), "name").alias("path"), F.array("id").alias("ancestors"), is_sidecar(F.col("name")).alias("pruned")
    )

    def counted(rows: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        out = materialised(rows.observe(seen, F.count(F.when(F.col("up").isNotNull(), 1)).alias("waiting")), "chains")
        return out, seen.get["waiting"]

    open_, waiting = counted(chain)
    done, left = None, None
    while True:
        finished = open_.where("up is null")
        done = finished if done is None else done.unionByName(finished)
        if not waiting or waiting == left:
            return done.drop("up")
        left = waiting
        rest = open_.where("up is not null")
        above = done.unionByName(rest).select(
            F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("before"), F.col("ancestors").alias("over"), F.col("pruned").alias("cut")
        )
        open_, waiting = counted(rest.join(above, "up").select(
            "id", F.col("next").alias("up"), F.concat("before", "path").alias("path"), F.concat("over", "ancestors").alias("ancestors"), (F.col("pruned") | F.col("cut")).alias("pruned")
        ))


def _housed(dirs: DataFrame, files: DataFrame, root) -> DataFrame:
    """files with the parent of those whose directory is missing replaced by root; with none named they stay as they are."""
    if root is None:
        return files
    known = dirs.select(F.col("id").alias("parent"), F.lit(True).alias("_known")).distinct()
    rows = files.join(known, "parent", "left")
    return rows.withColumn("parent", F.when(F.col("_known"), F.col("parent")).otherwise(F.lit(root))).drop("_known")


def subtree_totals(dirs: DataFrame, files: DataFrame, root=None) -> DataFrame:
    """id, size, nfiles of every directory that is not pruned: sums over all files (parent, name, size) below it, 0 if none.

    Side files and what lies in pruned directories do not count. Files are summed by their own directory first; only those
    sums are dealt to the ancestors. Directories and files whose parent is missing count in `root`, if it is named.
    """
    tree = directories(dirs, root).where("not pruned")
    kept = _housed(dirs, files, root).where(~is_sidecar(F.col("name")))
    own = kept.groupBy(F.col("parent").alias("id")).agg(F.sum(F.coalesce("size", F.lit(0))).alias("size"), F.count("*").alias("nfiles"))
    spread = tree.join(own, "id").select(F.explode("ancestors").alias("id"), "size", "nfiles")
    totals = spread.groupBy("id").agg(F.sum("size").alias("size"), F.sum("nfiles").alias("nfiles"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return tree.select("id", "path").join(totals, "id", "left").select("id", "path", zero("size"), zero("nfiles"))


def file_paths(dirs: DataFrame, files: DataFrame, root=None) -> DataFrame:
    """path and the other columns of files whose directory is reachable and not pruned; side files are left out."""
    tree = directories(dirs, root).where("not pruned").select(F.col("id").alias("parent"), F.col("path").alias("folder"), "ancestors")
    kept = _housed(dirs, files, root).where(~is_sidecar(F.col("name"))).join(tree, "parent")
    return kept.withColumn("path", F.concat("folder", F.lit("/"), "name")).drop("folder")


def children_sorted(nodes: DataFrame) -> DataFrame:
    """nodes (parent, isdir, name) with rn: directories first, then by name without regard to case, then by name."""
    w = Window.partitionBy("parent").orderBy(F.desc("isdir"), F.lower("name"), "name")
    return nodes.withColumn("rn", F.row_number().over(w))


def selection_state(dirs: DataFrame, chosen: DataFrame) -> DataFrame:
    """id, state of each directory: FULL if itself or an ancestor is in chosen (id), PARTIAL if a descendant is, else NONE."""
    tree = directories(dirs).select("id", "ancestors")
    marks = tree.select("id", F.explode("ancestors").alias("a")).join(chosen.select(F.col("id").alias("a")).distinct(), "a")
    full = marks.select("id").distinct().withColumn("full", F.lit(True))
    above = tree.join(chosen.distinct(), "id", "left_semi").select(F.explode("ancestors").alias("id")).distinct().withColumn("part", F.lit(True))
    state = F.when(F.col("full"), "FULL").when(F.col("part"), "PARTIAL").otherwise("NONE")
    return tree.select("id").join(full, "id", "left").join(above, "id", "left").select("id", state.alias("state"))


def toggle_on(dirs: DataFrame, chosen: DataFrame, node) -> DataFrame:
    """chosen with node added; chosen nodes below it go, as it covers them; unchanged if an ancestor is chosen already."""
    tree = directories(dirs).select("id", "ancestors")
    below = tree.where(F.array_contains("ancestors", F.lit(node))).select("id")
    covered = chosen.join(tree.where(F.col("id") == node).select(F.explode("ancestors").alias("id")), "id", "left_semi")
    rest = chosen.select("id").join(below, "id", "left_anti")
    added = tree.where(F.col("id") == node).select("id").join(covered.select(F.lit(node).alias("id")).distinct(), "id", "left_anti")
    kept = covered.select("id")
    return rest.unionByName(added).unionByName(kept).distinct()


def toggle_off(dirs: DataFrame, chosen: DataFrame, node) -> DataFrame:
    """chosen without node's subtree: a chosen ancestor is replaced by the siblings along the chain from it down to node."""
    tree = directories(dirs).select("id", "ancestors")
    chain = tree.where(F.col("id") == node).select(F.posexplode("ancestors").alias("depth", "id"))
    marked = chain.join(chosen.select("id", F.lit(True).alias("marked")).distinct(), "id", "left")
    top = F.min(F.when(F.col("marked"), F.col("depth"))).over(Window.partitionBy(F.lit(1)))  # as many rows as the node is deep
    path = marked.withColumn("top", top).where("depth >= top").select("depth", "id")
    siblings = dirs.select("id", "parent").join(path.where(F.col("id") != node).select(F.col("id").alias("parent")), "parent", "left_semi")
    siblings = siblings.select("id").join(path.select("id"), "id", "left_anti")
    below = tree.where(F.array_contains("ancestors", F.lit(node))).select("id")
    rest = chosen.select("id").join(path.select("id"), "id", "left_anti").join(below, "id", "left_anti")
    return rest.unionByName(siblings).distinct()


def select_all(dirs: DataFrame) -> DataFrame:
    """The selection (id) that covers everything: the roots, and rows whose parent is missing."""
    known = dirs.select(F.col("id").alias("parent")).distinct()
    roots = dirs.where("parent is null or parent = id").select("id")
    return roots.unionByName(dirs.where("parent is not null").join(known, "parent", "left_anti").select("id")).distinct()


def select_none(dirs: DataFrame) -> DataFrame:
    """The selection of nothing."""
    return dirs.select("id").where("false")
