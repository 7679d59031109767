"""Writing rebuilt files to a shared folder, and the manifest rows that say what was written."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_files(parts: DataFrame, target: str) -> DataFrame:
    """p, s, m, o, error for every file of parts (path, seq, data, ovf, mtime), written below target, a folder all executors share.

    A file's chunks meet in one partition in order and are streamed: memory holds one batch, whatever the file's size. Each
    attempt writes a .part of its own, which replaces the file in one step when it is whole; so a task that runs twice, or an
    executor that is lost, leaves no half file. Null data (a chunk that nothing decoded) makes the file an error row.
    """
    spark = parts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = parts.select("path", F.col("seq").cast("long"), "data", F.col("ovf").cast("long"), F.col("mtime").cast("long"))
    rows = rows.repartition(n, "path").sortWithinPartitions("path", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def close() -> list[tuple]:
            if not state:
                return []
            state["file"].close()
            out = (state["path"], state["size"], state["md5"].hexdigest(), state["ovf"], state["error"])
            if state["error"]:
                os.unlink(state["part"])
            else:
                os.replace(state["part"], state["place"])
                if state["mtime"]:
                    os.utime(state["place"], (state["mtime"],) * 2)
            state.clear()
            return [out]

        def made(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["p", "s", "m", "o", "error"])

        for b in batches:
            out: list[tuple] = []
            for path, data, ovf, mtime in zip(*[b.column(c).to_pylist() for c in ("path", "data", "ovf", "mtime")], strict=True):
                if state.get("path") != path:
                    out += close()
                    place = os.path.normpath(os.path.join(target, path.lstrip("/")))
                    if os.path.commonpath([place, os.path.normpath(target)]) != os.path.normpath(target):
                        raise ValueError(f"{path} leads out of the target folder")
                    os.makedirs(os.path.dirname(place), exist_ok=True)
                    part = f"{place}.{uuid.uuid4().hex}.part"
                    state.update(path=path, place=place, part=part, file=open(part, "wb"), md5=hashlib.md5(), size=0, ovf=ovf, mtime=mtime, error=None)  # noqa: SIM115
                if data is None:
                    state["error"] = "a chunk could not be decoded"
                else:
                    state["file"].write(data)
                    state["md5"].update(data)
                    state["size"] += len(data)
            yield made(out)
        yield made(close())

    return rows.mapInArrow(run, "p string, s long, m string, o long, error string")


def progress_rows(parts: DataFrame, step: int = 1 << 22) -> DataFrame:
    """k, p, b: what writing each file of parts (path, seq, length) reports: P with the bytes of each batch of `step` or more,
    P with what is left at its end, and O for the file. Parts are streamed in order; memory holds one count."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = parts.select("path", F.col("seq").cast("long"), F.col("length").cast("long")).repartition(n, "path").sortWithinPartitions("path", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, pending = None, 0

        def made(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["k", "p", "b"])

        def end() -> list[tuple]:
            return ([("P", path, pending)] if pending else []) + ([("O", path, 0)] if path is not None else [])

        for b in batches:
            out: list[tuple] = []
            for own, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True):
                if own != path:
                    out += end()
                    path, pending = own, 0
                pending += length or 0
                if pending >= step:
                    out.append(("P", path, pending))
                    pending = 0
            yield made(out)
        yield made(end())

    return rows.mapInArrow(run, "k string, p string, b long")


def sweep_parts(target: str) -> int:
    """Delete what interrupted writers left below target; how many files that was."""
    found = [os.path.join(d, f) for d, _, files in os.walk(target) for f in files if f.endswith(".part")]
    for f in found:
        os.unlink(f)
    return len(found)
