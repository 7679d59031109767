"""Backup versions: which are usable, which is the default, which was newest at a moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class VersionError(Exception):
    """A version can't be chosen."""


class InvalidVersionSpec(VersionError):
    """The specification is malformed."""


class VersionNotFound(VersionError):
    """Well formed, but there is no such usable version."""


def complete(status: Column) -> Column:
    """True, False, or null where no status is recorded."""
    return F.when(status.isNotNull(), status == "Complete")


def usable(versions: DataFrame, present: DataFrame | None = None, allow_incomplete: bool = False) -> DataFrame:
    """Versions (id, timestamp, status) with file lists in some share (present: id), not known to be incomplete unless allowed."""
    found = versions if present is None else versions.join(present.select("id").distinct(), "id", "left_semi")
    return found if allow_incomplete else found.where(F.coalesce(complete(F.col("status")), F.lit(True)))


def newest(candidates: DataFrame) -> DataFrame:
    """The default version: the largest id."""
    return candidates.agg(F.max("id").alias("id")).where("id is not null")


def latest_as_of(cutoffs: DataFrame, candidates: DataFrame, width: int = 30 * 86400) -> DataFrame:
    """cutoffs (cutoff) with id: of candidates (id, timestamp), the newest by (timestamp, id) at or before each; null if none.

    Time is cut into buckets. The newest of all earlier buckets comes from a running maximum over one row a bucket; only the
    cutoff's own bucket is joined row by row, on equality of buckets.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    stamp = F.struct(F.col("timestamp").alias("ts"), F.col("id").alias("id"))
    rows = candidates.where("timestamp is not null").select(bucket("timestamp").alias("b"), stamp.alias("v"))
    asked = cutoffs.select("cutoff").distinct().withColumn("b", bucket("cutoff"))
    tops = rows.groupBy("b").agg(F.max("v").alias("top")).withColumn("asked", F.lit(False))
    marks = asked.select("b").distinct().select("b", F.lit(None).cast("struct<ts:bigint,id:bigint>").alias("top"), F.lit(True).alias("asked"))
    running = F.max("top").over(Window.orderBy("b").rangeBetween(Window.unboundedPreceding, -1))  # one row a bucket
    before = tops.select("b", F.col("top").cast("struct<ts:bigint,id:bigint>").alias("top"), "asked").unionByName(marks)
    before = before.withColumn("before", running).where("asked").select("b", "before")
    within = asked.join(rows, "b").where(F.col("v.ts") <= F.col("cutoff")).groupBy("cutoff").agg(F.max("v").alias("own"))
    out = asked.join(before, "b", "left").join(within, "cutoff", "left")
    return out.select("cutoff", F.coalesce(F.col("own.id"), F.col("before.id")).alias("id"))


def shares_of(presence: DataFrame) -> DataFrame:
    """id, shares: the shares that hold each version, as a sorted comma list. presence: id, share."""
    return presence.distinct().groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("share")), ",").alias("shares"))


def resolve(versions: DataFrame, present: DataFrame | None, spec: str | None, allow_incomplete: bool = False) -> int:
    """The version that spec names: None for the newest by id, @moment for the newest by time, or an id.

    Each case reads one aggregated row. Errors say why a version can't be used: malformed, unknown, without file lists (checked
    first), or incomplete.
    """
    from ..functions.expr import moment_bound

    fit = usable(versions, present, allow_incomplete)
    if spec is None:
        row = newest(fit).first()
        if row is None:
            raise VersionNotFound("no usable version")
        return row.id
    if spec.startswith("@"):
        cutoff = versions.sparkSession.range(1).select(moment_bound(F.lit(spec[1:])).alias("t")).first().t
        if cutoff is None:
            raise InvalidVersionSpec(spec)
        best = fit.where(F.col("timestamp") <= cutoff).agg(F.max(F.struct("timestamp", "id")).alias("v"), F.count("*")).first()
        if best.v is None:
            dated = fit.where("timestamp is not null").isEmpty()
            raise VersionNotFound("records no version dates" if dated else f"no version at or before {spec[1:]}")
        return best.v.id
    if not (spec.isascii() and spec.isdigit()):
        raise InvalidVersionSpec(spec)
    wanted = int(spec)
    row = versions.where(F.col("id") == wanted).first()
    if row is None:
        known = versions.agg(F.min("id").alias("a"), F.max("id").alias("z")).first()
        raise VersionNotFound(f"no version {wanted}; ids run from {known.a} to {known.z}")
    if present is not None and present.where(F.col("id") == wanted).isEmpty():
        reason = "the backup failed" if row.status not in (None, "Complete") else "removed by retention"
        raise VersionNotFound(f"version {wanted} has no file lists: {reason}")
    if row.status not in (None, "Complete") and not allow_incomplete:
        raise VersionNotFound(f"version {wanted} is incomplete ({row.status})")
    return wanted
