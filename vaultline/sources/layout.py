"""Where things lie in an archive: questions to one listing of its files, at any depth and on any store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length, modified of all files below a folder whose names fit the pattern. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    path = F.regexp_replace("path", r"^[a-z][a-z0-9+.\-]*:(?://[^/]*)?(?=/)", "")
    return files.select(path.alias("path"), "length", F.col("modificationTime").alias("modified")).where(~F.col("path").rlike(r"/\._[^/]*$"))


def archives(files: DataFrame) -> DataFrame:
    """root: the folders that hold both a Pool and a Config folder with files. Archives inside an archive are not looked for."""
    inside = r"^(.*?)/(Config|Pool)/"
    rows = files.select(F.regexp_extract("path", inside, 1).alias("root"), F.regexp_extract("path", inside, 2).alias("kind"))
    kinds = rows.where("kind <> ''").groupBy("root").agg(F.countDistinct("kind").alias("n"))
    return kinds.where("n = 2").select("root")


def generations(files: DataFrame, name: Column | None = None) -> DataFrame:
    """base, gen, path: the newest generation of every file base[.gen]; a suffix that isn't a number belongs to the base."""
    name = F.col("path") if name is None else name
    part = lambda k: F.regexp_extract(name, r"(?s)^(.*?)(?:\.(\d+))?$", k)
    rows = files.select("path", part(1).alias("base"), F.when(part(2) == "", 0).otherwise(part(2).cast("long")).alias("gen"))
    return rows.groupBy("base").agg(F.max("gen").alias("gen"), F.max_by("path", "gen").alias("path"))


def share_versions(files: DataFrame) -> DataFrame:
    """share, id for every version that a share has a file list of."""
    pattern = r"/@Share/([^/]+)/(\d+)\.db(?:\.\d+)?$"
    rows = files.select(F.regexp_extract("path", pattern, 1).alias("share"), F.regexp_extract("path", pattern, 2).alias("id"))
    return rows.where("id <> ''").select("share", F.col("id").cast("long")).distinct()


def pools(files: DataFrame) -> DataFrame:
    """pool, files, bytes of the numbered folders of Pool; the smallest is the one that readers use."""
    n = F.regexp_extract("path", r"/Pool/(\d+)/", 1)
    return files.where(n != "").groupBy(n.cast("long").alias("pool")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def version_lines(versions: DataFrame, presence: DataFrame) -> DataFrame:
    """id, line: each version with its local time, unix time, status and shares, tab-separated, - for what is unknown."""
    from ..functions.expr import iso_text
    from ..operators.versions import shares_of

    dash = lambda c: F.coalesce(c, F.lit("-"))
    rows = versions.join(shares_of(presence), "id", "left")
    line = F.concat_ws("\t", F.col("id").cast("string"), dash(iso_text(F.col("timestamp"))), dash(F.col("timestamp").cast("string")), dash(F.nullif("status", F.lit(""))), dash(F.col("shares")))
    return rows.select("id", line.alias("line"))
