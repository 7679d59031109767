"""Restoring: manifests, resume decisions, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_record(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key by order; a later one voids or replaces what was before."""
    others = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, "r.*")


def decision(size: Column, have: Column, ovf: Column, recorded: Column, recorded_ovf: Column, md5_same: Column, strict: bool) -> Column:
    """skip or extract. have: the destination's size (null if it is not there); recorded: whether the manifest has a record.

    Another size always extracts. Without a record the size decides, unless strict; a record of another object or of none
    extracts; one of this object skips, if strict only with the same digest.
    """
    no_record = F.lit("extract" if strict else "skip")
    known = F.when(F.coalesce(md5_same, F.lit(False)), "skip").otherwise("extract") if strict else F.lit("skip")
    right_size = F.when(~recorded, no_record).when(recorded_ovf.isNull() | (recorded_ovf != ovf), "extract").otherwise(known)
    return F.when(have.isNull() | (have != size), "extract").otherwise(right_size)


def stale(cached: DataFrame, present: DataFrame, current: DataFrame) -> DataFrame:
    """Of cached indexes (root, version, name) those that can't be used again: of an archive in current (root, version, keep) those
    without a version, of its current version except the one to keep, and of versions that present (root, version) no longer has.

    Indexes of archives that current doesn't name are never touched.
    """
    mine = cached.join(current.select("root", F.col("version").alias("now"), "keep"), "root").where(~F.col("name").eqNullSafe(F.col("keep")))
    have = present.select("root", "version", F.lit(True).alias("have")).distinct()
    out = mine.join(have, ["root", "version"], "left")
    gone = F.col("version").isNull() | (F.col("version") == F.col("now")) | F.col("have").isNull()
    return out.where(gone).select("root", "version", "name")


def index_key(entries: DataFrame, group: str, order: str, text: Column, block: Column, prefix: Column) -> DataFrame:
    """group, fingerprint: 16 hex digits over prefix and the ordered texts of each group, as the key of an index built from them.

    Texts are digested by block, which must follow the order, and blocks by group, so that no row holds a whole group.
    """
    rows = entries.select(group, block.alias("block"), prefix.alias("prefix"), F.struct(F.col(order).alias("o"), text.alias("e")).alias("x"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x.e), "|")
    blocks = rows.groupBy(group, "block").agg(F.sha1(joined("x")).alias("e"), F.min("prefix").alias("prefix"))
    whole = blocks.groupBy(group).agg(F.min("prefix").alias("prefix"), joined(F.struct("block", "e")).alias("text"))
    return whole.select(group, F.substring(F.sha1(F.concat_ws("|", "prefix", "text")), 1, 16).alias("fingerprint"))


def with_failed_workers(events: DataFrame, workers: DataFrame) -> DataFrame:
    """events (worker, k, message) and an E row for each of workers (worker) that never reported its end (D)."""
    ended = events.where("k = 'D'").select("worker").distinct()
    lost = workers.select("worker").distinct().join(ended, "worker", "left_anti")
    return events.select("worker", "k", "message").unionByName(lost.select("worker", F.lit("E").alias("k"), F.lit("worker ended without reporting").alias("message")))


def live_workers(events: DataFrame) -> DataFrame:
    """live: how many workers have sent something and not their end."""
    per = events.groupBy("worker").agg(F.max(F.col("k") == "D").alias("ended"))
    return per.agg(F.coalesce(F.sum((~F.col("ended")).cast("long")), F.lit(0)).alias("live"))


def error_report(errors: DataFrame, order: list[str], text: Column, n: int = 20) -> DataFrame:
    """rn, line: the first n errors, and one line that counts the others, if there are any."""
    top = errors.orderBy(*order).limit(n).withColumn("rn", F.row_number().over(Window.orderBy(*order)).cast("long"))
    more = errors.agg(F.count("*").alias("all")).where(F.col("all") > n)
    rest = more.select(F.lit(n + 1).cast("long").alias("rn"), F.concat(F.lit("  and "), F.format_number(F.col("all") - n, 0), F.lit(" more")).alias("line"))
    return top.select("rn", F.concat(F.lit("  failed: "), text).alias("line")).unionByName(rest)


def counters(events: DataFrame) -> DataFrame:
    """ok, skipped, failed, bytes_done of progress events (k, b): P and S add bytes, O and E count."""
    n = lambda k: F.sum((F.col("k") == k).cast("long"))
    done = F.sum(F.when(F.col("k").isin("P", "S"), F.col("b")).otherwise(0))
    return events.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(a) for c, a in ((n("O"), "ok"), (n("S"), "skipped"), (n("E"), "failed"), (done, "bytes_done"))])


def recent(events: DataFrame, order: list[str], n: int = 15) -> DataFrame:
    """The last n completed files with rn, newest first: a top-n report."""
    top = events.where("k = 'O'").orderBy(*[F.desc(c) for c in order]).limit(n)
    return top.withColumn("rn", F.row_number().over(Window.orderBy(*[F.desc(c) for c in order])))


def throughput(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """bucket, bytes, previous, done, pct, eta per time bucket. Buckets, not events, are ordered in one task.

    eta: the seconds that what is left takes at the speed since the first bucket began, 0 where nothing was done.
    """
    bucket = (F.floor(F.col("ts") / seconds) * seconds).cast("long")
    per = events.where(F.col("k").isin("P", "S")).groupBy(bucket.alias("bucket")).agg(F.sum("b").cast("long").alias("bytes"))
    w = Window.orderBy("bucket")
    done = F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("bytes").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = per.select("bucket", "bytes", F.lag("bytes").over(w).alias("previous"), done.cast("long").alias("done"), total.alias("total"))
    out = out.withColumn("pct", F.when(F.col("total") == 0, 100).otherwise(F.floor(100 * F.col("done") / F.col("total"))).cast("long"))
    elapsed = F.col("bucket") + seconds - F.min("bucket").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    eta = F.when(F.col("done") > 0, F.floor((F.col("total") - F.col("done")) * elapsed / F.col("done"))).otherwise(0)
    return out.withColumn("eta", eta.cast("long")).drop("total")
