"""Queries over a whole archive: documents are packed into one, and read back through its files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import archive
from ..sources.packer import pack
from ..sources.storage import materialised, shared_folder, table

#: The content of a group of rows (seq, data), copied once however many there are; null if a chunk is missing.
JOINED = "CASE WHEN count_if(data IS NULL) = 0 THEN listagg(data, X'') WITHIN GROUP (ORDER BY seq) END"


def _archive(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    docs = table(spark, sf, "documents").where("text is not null")
    files = docs.select(F.col("doc_id").cast("string").alias("file"), F.col("text").cast("binary").alias("content"))
    root = f"{shared_folder(spark).removeprefix('file:')}/archive-{uuid.uuid4().hex}"
    return f"{root}/Pool/1", materialised(pack(files, root), "lists")


def _rebuilt(spark: SparkSession, pool: str, lists: DataFrame, places: DataFrame) -> DataFrame:
    """file, size, md5, ok of the files in lists (file, off, size): read from buckets by way of lists and chunk index."""
    found = archive.shards(spark, f"{pool}/chunk_index.index")
    size = archive.record_size(found, "chunk_index")
    resolved = materialised(archive.resolved_chunks(archive.chunk_records(archive.records(found, size), size)), "resolved")
    index = materialised(archive.bucket_records(spark, pool), "index")
    parts = archive.file_chunks(lists.where("off is not null"), archive.shards(spark, f"{pool}/file_chunk1.index"), resolved, index, places)
    parts = materialised(parts.where("needed"), "parts")
    wanted = index.join(parts.select("bucket", "offset").distinct(), ["bucket", "offset"], "left_semi")
    data = archive.payloads(spark, pool, wanted)
    rows = parts.join(data, ["bucket", "offset"], "left").groupBy("file")
    whole = rows.agg(F.expr(JOINED).alias("content"), F.min("exact").alias("exact"), F.max("error").alias("error"))
    out = lists.join(whole, "file", "left").withColumn("content", F.coalesce("content", F.lit(b"")))
    ok = F.coalesce("exact", F.lit(True)) & F.col("error").isNull() & (F.length("content") == F.col("size"))
    return out.select("file", "size", F.md5("content").alias("md5"), ok.alias("ok"))


def archive_rebuild(spark, sf):
    """Every file of the archive, rebuilt and verified."""
    pool, lists = _archive(spark, sf)
    return _rebuilt(spark, pool, lists, lists.where("off is not null").select("off"))


def archive_selection(spark, sf):
    """The files whose name ends in 7: their lists alone are read, and a second name of each that shares its list."""
    pool, lists = _archive(spark, sf)
    chosen = lists.where("file like '%7'")
    chosen = chosen.unionByName(chosen.withColumn("file", F.concat("file", F.lit("-copy"))))
    return _rebuilt(spark, pool, chosen, lists.where("off is not null").select("off"))


def archive_check(spark, sf):
    """What the archive's own indexes say: buckets, chunks, bytes stored and unpacked, damaged records."""
    pool, _ = _archive(spark, sf)
    r = archive.bucket_records(spark, pool)
    sums = [F.count("*").alias("chunks"), F.sum("ulen").alias("plain"), F.sum((~F.col("crc_ok")).cast("long")).alias("damaged")]
    return r.agg(F.countDistinct("bucket").alias("buckets"), *sums)


QUERIES = {f.__name__: f for f in (archive_rebuild, archive_selection, archive_check)}

_FILES = "f AS (SELECT doc_id::VARCHAR AS file, text, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL)"

ORACLE_SQL = {
    "archive_rebuild": f"WITH {_FILES} SELECT file, size, md5(text) AS md5, true AS ok FROM f",
    "archive_selection": f"""WITH {_FILES} SELECT file, size, md5(text) AS md5, true AS ok FROM f WHERE file LIKE '%7'
        UNION ALL SELECT file || '-copy', size, md5(text), true FROM f WHERE file LIKE '%7'""",
    "archive_check": f"""WITH {_FILES}, h AS (SELECT hex(encode(text)) AS h, size FROM f),
        c AS (SELECT DISTINCT substring(h, CAST(8192 * i + 1 AS BIGINT), 8192) AS c FROM (SELECT h, unnest(range(0, (size + 4095) // 4096)) AS i FROM h))
        SELECT CAST(ceil(count(*) / 512.0) AS BIGINT) AS buckets, count(*) AS chunks, CAST(sum(length(c) // 2) AS BIGINT) AS plain, CAST(0 AS BIGINT) AS damaged FROM c""",
}
