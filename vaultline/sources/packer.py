"""Writing a small archive in the format that sources/archive.py reads, for queries and tests that need one."""

from __future__ import annotations

import hashlib
import os
import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import MIB_8
from ..operators.chunks import split
from ..operators.ordering import numbered
from .archive import HEADER, MAGIC
from .storage import free_shuffles, materialised

#: Chunks in a bucket.
PER_BUCKET = 512


def _header(size: int) -> bytes:
    return struct.pack(">16I", MAGIC, 1, 0, 0, size, *[0] * 11)


def _write(path: str, data: bytes) -> None:
    """The file in one step, so that a task that runs twice leaves a whole one."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


def _stream(rows: DataFrame, folder: str, record: int) -> None:
    """Shards of the stream that holds each of rows (at, data) at its place, behind a header."""
    cut = F.explode(F.sequence(F.floor(F.col("at") / MIB_8), F.floor((F.col("at") + F.length("data") - 1) / MIB_8)))

    def shard(pieces: pd.DataFrame) -> pd.DataFrame:
        n = int(pieces["n"].iloc[0])
        out = bytearray(MIB_8)
        out[:HEADER] = _header(record) if n == 0 else out[:HEADER]
        end = HEADER if n == 0 else 0
        for at, data in zip(pieces["at"], pieces["data"], strict=True):
            start = at - n * MIB_8
            part = data[max(0, -start) : MIB_8 - start]
            out[max(0, start) : max(0, start) + len(part)] = part
            end = max(end, max(0, start) + len(part))
        _write(f"{folder}/{n}.idx", bytes(out[:end]))
        return pd.DataFrame({"n": [n]})

    rows.withColumn("n", cut).groupBy("n").applyInPandas(shard, "n long").count()


def pack(files: DataFrame, folder: str, chunk: int = 4096) -> DataFrame:
    """file, off, size of every file of files (file string, content binary) in a new archive below folder, which executors share.

    Content is cut every `chunk` bytes; equal chunks are stored once. Buckets, index shards and lists are each
    written by the tasks that hold them, and bounded: 512 chunks, or 8 MiB. Digests stand for chunks until the buckets
    are known; then files are cut again, so that no bytes lie in tables between.
    """
    pieces = split(files.select("file", "content"), "content", chunk).select("file", "seq", F.col("chunk").alias("data"))
    pieces = pieces.withColumn("md5", F.unhex(F.md5("data")))
    cut = materialised(pieces.drop("data"), "cut")
    first = cut.groupBy("md5").agg(F.min(F.struct("file", "seq")).alias("first")).select("md5", "first.file", "first.seq")
    stored = numbered(first, "md5").withColumn("i", F.col("rn") - 1).drop("rn")
    stored = materialised(stored.withColumns({"bucket": F.floor(F.col("i") / PER_BUCKET), "slot": (F.col("i") % PER_BUCKET).cast("int")}), "stored")
    chunks = pieces.join(stored, ["file", "seq", "md5"]).select("bucket", "i", "data")

    def bucket(rows: pd.DataFrame) -> pd.DataFrame:
        index, data, size, number = [_header(32)], [], 0, int(rows["bucket"].iloc[0])
        for i, plain in sorted(dict(zip(rows["i"], rows["data"], strict=True)).items()):  # files of one name may bring a chunk twice
            raw = zlib.compress(plain) if i % 2 else plain
            record = struct.pack(">III", len(raw), size, len(plain)) + hashlib.md5(plain).digest()
            index.append(record + struct.pack(">I", zlib.crc32(record)))
            data.append(raw)
            size += len(raw)
        _write(f"{folder}/Pool/1/{number >> 11}/{number & 2047}.index", b"".join(index))
        _write(f"{folder}/Pool/1/{number >> 11}/{number & 2047}.bucket", b"".join(data))
        return pd.DataFrame({"bucket": [number]})

    chunks.groupBy("bucket").applyInPandas(bucket, "bucket long").count()
    free_shuffles(files.sparkSession)
    big = lambda c, digits: F.unhex(F.lpad(F.hex(c.cast("long")), digits, "0"))
    key = F.lit(HEADER) + 29 * F.col("i")
    record = F.concat(F.unhex(F.lit("00")), big(F.col("bucket"), 8), big(HEADER + 32 * F.col("slot"), 8), F.unhex(F.lit("00" * 20)))
    _stream(stored.select(key.cast("long").alias("at"), record.alias("data")), f"{folder}/Pool/1/chunk_index.index", 29)
    keyed = cut.select("file", "seq", "md5").join(stored.select("md5", key.cast("long").alias("key")), "md5")
    keyed = numbered(keyed.select("file", "seq", "key"), "file", "seq", name="g")
    named = numbered(cut.select("file").distinct(), "file", name="f")
    place = F.lit(HEADER) + 12 * F.col("f") + 8 * (F.col("g") - 1)
    keyed = materialised(keyed.join(named, "file").select("file", "seq", "key", place.cast("long").alias("at")), "keyed")
    _stream(keyed.select("at", big(F.col("key"), 16).alias("data")), f"{folder}/Pool/1/file_chunk1.index", 0)
    lists = keyed.groupBy("file").agg(F.min("at").alias("off"))
    return files.select("file", F.length("content").cast("long").alias("size")).join(lists, "file", "left").select("file", "off", "size")
