"""A backup archive's files as DataFrames: shard streams, fixed-width records, buckets, SQLite lists, manifests, task settings.

Everything is read by Spark's own file sources, so an archive may lie on any store that Spark reads; what has to be decoded in
Python is decoded in Arrow batches, one shard, bucket or database to a row.
"""

from __future__ import annotations

import json
import os
import sqlite3
import tempfile
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codecs import decode_chunk
from ..functions.expr import MIB_8, be_i32, be_i64, be_u32
from ..operators.chunks import follow, needed
from ..operators.ordering import numbered

#: Fixed values of the format.
MAGIC, HEADER = 0x7053A86E, 64
RECORD_SIZES = {"virtual_file": (56,), "chunk_index": (16, 29), "bucket": (28, 32)}
#: Bytes of a shard that meet a read at once.
PAGE = 4096


class UnsupportedArchive(Exception):
    """The archive has a layout that is not known; nothing is guessed."""


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """n, start, data of the newest generation of each shard <n>.idx[.gen] in a folder; start follows from n, so gaps stay gaps."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*.idx*").load(folder)
    name = F.regexp_extract("path", r"/([^/]+)$", 1)
    part = lambda k: F.regexp_extract(name, r"^(\d+)\.idx(?:\.(\d+))?$", k)
    rows = files.where(part(1) != "").select(part(1).cast("long").alias("n"), F.when(part(2) == "", 0).otherwise(part(2).cast("long")).alias("gen"), "path", F.col("content").alias("data"))
    newest = F.broadcast(rows.groupBy("n").agg(F.max("gen").alias("gen")))  # a row a file, of those that the driver lists
    return rows.join(newest, ["n", "gen"]).select("n", (F.col("n") * MIB_8).alias("start"), "data")


def record_size(found: DataFrame, family: str) -> int:
    """The record size that the first shard's header names, checked against what the format knows."""
    row = found.orderBy("n").select(F.length("data").alias("n"), be_u32(F.col("data"), 1).alias("magic"), be_u32(F.col("data"), 17).alias("size")).first()
    if row is None or row.n < HEADER or row.magic != MAGIC:
        raise UnsupportedArchive(f"{family}: no valid header")
    if row["size"] not in RECORD_SIZES[family]:
        raise UnsupportedArchive(f"{family}: records of {row['size']} bytes")
    return row["size"]


def _cut(rows: DataFrame) -> DataFrame:
    """id, at, size, piece of rows (id, first, size, data): data cut every `size` bytes, the last piece may be shorter; at is first plus the bytes before.

    A shard holds hundreds of thousands of records; an expression over each of them would copy the whole shard as often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, first, size, data in zip(*[b.column(c).to_pylist() for c in ("id", "first", "size", "data")], strict=True):
                ends = np.minimum(np.arange(0, len(data) + size, size), len(data)).astype(np.int32)
                n = len(ends) - 1
                pieces = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data)])
                columns = [pa.array(np.full(n, own)), pa.array(first + size * np.arange(n)), pa.array(np.full(n, size, np.int32)), pieces]
                yield pa.RecordBatch.from_arrays(columns, ["id", "at", "size", "piece"])

    rows = rows.select(F.col("id").cast("long"), F.col("first").cast("long"), F.col("size").cast("int"), "data")
    return rows.mapInArrow(run, "id long, at long, size int, piece binary")


def ranges(reads: DataFrame, found: DataFrame) -> DataFrame:
    """reads (read, off, len) with data: the stream's bytes up to the first hole, short shard or end.

    Reads meet the shards' pages, so that neither what a read copies nor how many tasks share the reads hangs on the shards' size.
    """
    page = gcd(MIB_8, PAGE)
    pages = _cut(found.select(F.col("n").alias("id"), F.col("start").alias("first"), F.lit(page).alias("size"), "data"))
    pages = pages.select(F.floor(F.col("at") / page).cast("long").alias("n"), F.col("piece").alias("data"))
    last = F.floor((F.col("off") + F.col("len") - 1) / page).cast("long")
    touched = reads.where("len > 0").withColumn("n", F.explode(F.sequence(F.floor(F.col("off") / page).cast("long"), last)))
    met = touched.join(pages, "n", "left")
    a = F.greatest(F.lit(0), F.col("off") - F.col("n") * page)
    want = F.least(F.lit(page), F.col("off") + F.col("len") - F.col("n") * page) - a
    met = met.withColumn("want", want).withColumn("part", F.coalesce(F.substring("data", (a + 1).cast("int"), want.cast("int")), F.lit(b"")))
    w = Window.partitionBy("read").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("open", F.coalesce(F.min((F.length("part") == F.col("want")).cast("int")).over(w), F.lit(1)) == 1)
    joined = met.where("open").groupBy("read").agg(F.expr("listagg(part, X'') WITHIN GROUP (ORDER BY n)").alias("data"))
    return reads.join(joined, "read", "left").withColumn("data", F.coalesce("data", F.lit(b"")))


def records(found: DataFrame, size: int) -> DataFrame:
    """key (place in the stream), record for the fixed-width records of a family; records may straddle shards."""
    head = found.select((F.col("n") - 1).alias("n"), F.substring("data", 1, size - 1).alias("next"))
    rows = found.join(head, "n", "left")
    whole = F.length("data") == MIB_8
    rows = rows.withColumn("joined", F.when(whole, F.concat("data", F.coalesce("next", F.lit(b"")))).otherwise(F.col("data")))
    first = F.when(F.col("start") <= HEADER, F.lit(HEADER)).otherwise(F.ceil((F.col("start") - HEADER) / size) * size + HEADER).cast("long")
    end = F.least(F.col("start") + F.length("data") - 1, F.col("start") + F.length("joined") - size)
    rows = rows.withColumns({"first": first, "count": F.floor((end - first) / size) + 1}).where("count > 0")
    data = F.substring("joined", (F.col("first") - F.col("start") + 1).cast("int"), (F.col("count") * size).cast("int"))
    return _cut(rows.select(F.col("n").alias("id"), "first", F.lit(size).alias("size"), data.alias("data"))).select(F.col("at").alias("key"), F.col("piece").alias("record"))


def chunk_records(rows: DataFrame, size: int) -> DataFrame:
    """key, cite (null if direct), bucket, offset of chunk_index records of 29 or 16 bytes."""
    r = F.col("record")
    if size == 16:
        return rows.select("key", F.lit(None).cast("long").alias("cite"), be_i32(r, 1).alias("bucket"), be_i32(r, 5).alias("offset"))
    cited = F.conv(F.hex(F.substring(r, 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(1)) == 1
    return rows.select("key", F.when(cited, be_i64(r, 2)).alias("cite"), F.when(~cited, be_i32(r, 2)).alias("bucket"), F.when(~cited, be_i32(r, 6)).alias("offset"))


def _buckets(spark: SparkSession, pool: str, kind: str) -> DataFrame:
    """bucket, data of the newest generation of the files <dir>/<file>.<kind>[.gen]; the folder is part of the number."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{kind}*").load(pool)
    part = lambda k: F.regexp_extract("path", rf"/(\d+)/(\d+)\.{kind}(?:\.(\d+))?$", k)
    rows = files.where(part(2) != "").select((F.shiftleft(part(1).cast("long"), 11) + part(2).cast("long")).alias("bucket"), F.when(part(3) == "", 0).otherwise(part(3).cast("long")).alias("gen"), F.col("content").alias("data"))
    newest = F.broadcast(rows.groupBy("bucket").agg(F.max("gen").alias("gen")))  # a row a file: contents aren't shuffled for it
    return rows.join(newest, ["bucket", "gen"]).select("bucket", "data")


def bucket_records(spark: SparkSession, pool: str) -> DataFrame:
    """bucket, offset (of the record), clen, at, ulen, md5, crc_ok of every bucket index; crc_ok is null for records without a CRC."""
    found = _buckets(spark, pool, "index").withColumns({"magic": be_u32(F.col("data"), 1), "size": be_u32(F.col("data"), 17)})
    valid = (F.col("magic") == MAGIC) & F.col("size").isin(*RECORD_SIZES["bucket"])
    found = found.withColumn("size", F.when(valid, F.col("size")).otherwise(F.raise_error(F.concat(F.lit("unsupported bucket index "), F.col("bucket").cast("string")))))
    whole = F.floor((F.length("data") - HEADER) / F.col("size")) * F.col("size")
    rows = _cut(found.select(F.col("bucket").alias("id"), F.lit(HEADER).alias("first"), "size", F.substring("data", F.lit(HEADER + 1), whole.cast("int")).alias("data")))
    rows = rows.select(F.col("id").alias("bucket"), F.col("at").alias("offset"), "size", F.col("piece").alias("r"))
    ok = F.when(F.col("size") == 32, F.crc32(F.substring("r", 1, 28)) == be_u32(F.col("r"), 29))
    return rows.select("bucket", F.col("offset").cast("int").alias("offset"), be_u32(F.col("r"), 1).alias("clen"), be_u32(F.col("r"), 5).alias("at"), be_u32(F.col("r"), 9).alias("ulen"), F.substring("r", 13, 16).alias("md5"), ok.alias("crc_ok"))


def payloads(spark: SparkSession, pool: str, wanted: DataFrame, stored_first: bool = False, verify: bool = True) -> DataFrame:
    """bucket, offset, data of the chunks in wanted (as bucket_records gives them); data is null where nothing fits its digest.

    Each bucket file (about 50 MB) is read and moved once, to meet all that is wanted of it.
    """
    asked = wanted.groupBy("bucket").agg(F.collect_set(F.struct("offset", "clen", "at", "ulen", "md5")).alias("chunks"))
    rows = _buckets(spark, pool, "bucket").join(asked, "bucket").select("bucket", "data", "chunks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, data, chunks in zip(*[b.column(c).to_pylist() for c in ("bucket", "data", "chunks")], strict=True):
                out = [decode_chunk(data[c["at"] : c["at"] + c["clen"]], c["ulen"], c["md5"] if verify else None, stored_first) for c in chunks]
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(out), pa.int64()), pa.array([c["offset"] for c in chunks], pa.int32()), pa.array(out, pa.binary())], ["bucket", "offset", "data"])

    return rows.mapInArrow(run, "bucket long, offset int, data binary")


def list_ends(places: DataFrame) -> DataFrame:
    """off, next of the distinct offsets in places (off): next is the following one, null after the last."""
    rows = numbered(places.select("off").distinct(), "off")
    after = rows.select(F.col("off").alias("next"), (F.col("rn") - 1).alias("rn"))
    return rows.join(after, "rn", "left").select("off", "next")


def file_chunks(lists: DataFrame, found: DataFrame, resolved: DataFrame, index: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """file, seq, bucket, offset, needed, exact, error for lists (file, off, size) of one file_chunk family.

    A file's keys are read from its place on until their chunks' lengths reach its size. A list ends 12 bytes before the next
    one, and has no more keys than the file has bytes; files may share a list. Where lists holds some of the family's files
    only, `places` (off) names all lists, so that no more than a file's own list is read.
    resolved: key, bucket, offset, error of chunk_index records; index: bucket_records().
    """
    stream_end = found.agg(F.max(F.col("start") + F.length("data"))).first()[0] or 0
    ends = list_ends(lists.select("off") if places is None else places.select("off").unionByName(lists.select("off")))
    most = F.least(F.coalesce(F.col("next") - 12, F.lit(stream_end)) - F.col("off"), 8 * F.greatest("size", F.lit(0)))
    reads = lists.join(ends, "off").withColumn("len", most).select(F.col("file").alias("read"), "off", "len", "size")
    data = ranges(reads, found)
    each = F.regexp_extract_all(F.hex("data"), F.lit(".{16}"), F.lit(0))  # cut once: an expression for each key would copy the list as often
    keys = data.select(F.col("read").alias("file"), "size", F.posexplode(each).alias("seq", "hex"))
    keys = keys.select("file", "size", "seq", F.conv("hex", 16, -10).cast("long").alias("key"))
    rows = keys.join(resolved, "key", "left").join(index.select("bucket", "offset", "ulen"), ["bucket", "offset"], "left")
    rows = rows.withColumn("length", F.coalesce("ulen", F.lit(0)))
    return needed(rows, "file", "size", "length").select("file", "seq", "bucket", "offset", "needed", "exact", "error")


def resolved_chunks(rows: DataFrame) -> DataFrame:
    """key, bucket, offset, error: chunk_records with citations followed."""
    ends = follow(rows.select("key", "cite"))
    direct = rows.where("cite is null").select(F.col("key").alias("target"), "bucket", "offset")
    return ends.join(direct, "target", "left").select("key", "bucket", "offset", "error")


def sqlite_rows(spark: SparkSession, path: str, query: str, schema: str, pattern: str = "*.db*") -> DataFrame:
    """path, error and the columns of schema: the query's rows from every database below path.

    Each database is copied to the task's own temporary file and read there in batches. One that can't be read gives a row with
    its error and nulls, so that a damaged share is seen and the others are still read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")
    full = f"path string, error string, {schema}"
    arrow = _arrow_schema(spark, full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                with tempfile.TemporaryDirectory() as own:
                    place = os.path.join(own, "copy.db")
                    with open(place, "wb") as f:
                        f.write(content)
                    try:
                        db = sqlite3.connect(f"file:{place}?mode=ro&immutable=1", uri=True)
                        rows = db.execute(query)
                        while part := rows.fetchmany(20_000):
                            columns = list(zip(*part, strict=True))
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.nulls(len(part), pa.string()), *[pa.array(c, f.type) for c, f in zip(columns, list(arrow)[2:], strict=True)]], schema=arrow)
                        db.close()
                    except sqlite3.Error as e:
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([str(e)]), *[pa.nulls(1, f.type) for f in list(arrow)[2:]]], schema=arrow)

    return files.mapInArrow(run, full)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in spark.createDataFrame([], ddl).schema.fields])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """p, s, m, o, void: the last record of each path in a log of JSON lines; blank and torn lines are skipped.

    Order is that of the file's bytes: a line's place is its number within its partition, and partitions follow each other.
    """
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    record = F.from_json("value", "p string, s bigint, m string, o bigint, void int")
    rows = lines.select("at", record.alias("r")).where("r.p is not null")
    return rows.groupBy("r.p").agg(F.max_by("r", "at").alias("r")).select("r.*")


def append_manifest(log: str, rows: list[dict]) -> None:
    """One JSON line for each row at the end of a local log, by its single writer."""
    with open(log, "a", encoding="utf-8") as f:
        f.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)


def task_config(spark: SparkSession, path: str) -> DataFrame:
    """key, value of lines key=value; sections are skipped, quotes and blanks taken off, the last of a key wins."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    pair = lambda k: F.regexp_extract("value", r"^([^=]*)=(.*)$", k)
    rows = lines.where(F.col("value").contains("=") & ~F.ltrim("value").startswith("["))
    rows = rows.select(F.trim(pair(1)).alias("key"), F.regexp_replace(F.trim(pair(2)), '^"+|"+$', "").alias("value"), "at")
    return rows.groupBy("key").agg(F.max_by("value", "at").alias("value"))
