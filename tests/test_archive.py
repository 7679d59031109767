"""Archive readers on a small archive of our own making."""

import hashlib
import json
import random
import sqlite3
import struct
import time
import zlib
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vaultline.operators.chunks import split
from vaultline.plans import archives
from vaultline.sources import archive
from vaultline.sources.packer import pack
from vaultline.sources.storage import shared_folder


def header(size, kind=1):
    return struct.pack(">16I", archive.MAGIC, kind, 0, 0, size, *[0] * 11)


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    """Three files over five chunks: stored, zlib and LZ4, one of them cited."""
    root = tmp_path_factory.mktemp("archive")
    chunks = [b"alpha " * 50, b"beta" * 300, bytes(range(256)) * 4, b"z", b"beta" * 300]
    packed = [chunks[0], zlib.compress(chunks[1]), pa.Codec("lz4_raw").compress(chunks[2]).to_pybytes(), chunks[3]]
    pool = root / "Pool/1"
    (pool / "0").mkdir(parents=True)
    (pool / "3").mkdir(parents=True)
    places = []
    for bucket, mine in ((5, (0, 1)), (3 * 2048 + 5, (2, 3))):
        index, data = header(32, 2), b""
        for i in mine:
            record = struct.pack(">III", len(packed[i]), len(data), len(chunks[i])) + hashlib.md5(chunks[i]).digest()
            places.append((bucket, len(index)))
            index += record + struct.pack(">I", zlib.crc32(record))
            data += packed[i]
        folder = pool / str(bucket >> 11)
        (folder / f"{bucket & 2047}.index").write_bytes(index)
        (folder / f"{bucket & 2047}.bucket").write_bytes(b"old")
        (folder / f"{bucket & 2047}.bucket.2").write_bytes(data)
    ci = header(29)
    keys = []
    for bucket, offset in places:
        keys.append(len(ci))
        ci += bytes([0]) + struct.pack(">ii", bucket, offset) + bytes(20)
    keys.append(len(ci))
    ci += bytes([1]) + struct.pack(">q", keys[1]) + bytes(20)
    (pool / "chunk_index.index").mkdir()
    (pool / "chunk_index.index/0.idx").write_bytes(ci)
    files = {"a": [0, 1], "b": [2, 3, 4], "c": [4]}
    fc, lists = header(0), []
    for name, ids in files.items():
        fc += bytes(12)
        lists.append((name, len(fc), sum(len(chunks[i]) for i in ids)))
        fc += b"".join(struct.pack(">q", keys[i]) for i in ids)
    (pool / "file_chunk1.index").mkdir()
    (pool / "file_chunk1.index/0.idx.3").write_bytes(fc)
    (pool / "file_chunk1.index/0.idx").write_bytes(b"stale")
    return root, pool, lists, {n: b"".join(chunks[i] for i in ids) for n, ids in files.items()}


def extracted(spark, pool, lists):
    found = archive.shards(spark, f"{pool}/chunk_index.index")
    size = archive.record_size(found, "chunk_index")
    resolved = archive.resolved_chunks(archive.chunk_records(archive.records(found, size), size))
    index = archive.bucket_records(spark, str(pool))
    parts = archive.file_chunks(spark.createDataFrame(lists, "file string, off long, size long"), archive.shards(spark, f"{pool}/file_chunk1.index"), resolved, index)
    data = archive.payloads(spark, str(pool), index)
    rows = parts.where("needed").join(data, ["bucket", "offset"], "left").collect()
    out = {}
    for r in sorted(rows, key=lambda r: r.seq):
        out.setdefault(r.file, []).append(r)
    return out


def test_files_come_back_whole(spark, made):
    _, pool, lists, expected = made
    got = extracted(spark, pool, lists)
    assert {n: b"".join(bytes(r.data) for r in rows) for n, rows in got.items()} == expected
    assert all(r.exact and r.error is None for rows in got.values() for r in rows)
    assert archive.bucket_records(spark, str(pool)).where("not crc_ok").isEmpty()


def test_shared_lists_and_selections(spark, made):
    """Files that share a list all come back; a selection of one file reads no further than its own list."""
    _, pool, lists, expected = made
    a, b, c = lists
    got = extracted(spark, pool, [a, ("copy", a[1], a[2]), ("part", a[1], 300), b, c])
    assert {n: b"".join(bytes(r.data) for r in rows) for n, rows in got.items()} == {**expected, "copy": expected["a"], "part": expected["a"][:300]}
    found = archive.shards(spark, f"{pool}/file_chunk1.index")
    places = spark.createDataFrame([(x[1],) for x in lists], "off long")
    assert sorted(map(tuple, archive.list_ends(places.union(places)).collect())) == [(a[1], b[1]), (b[1], c[1]), (c[1], None)]
    assert b"".join(bytes(r.data) for r in extracted(spark, pool, [b])["b"]) == expected["b"]
    ci = archive.shards(spark, f"{pool}/chunk_index.index")
    resolved = archive.resolved_chunks(archive.chunk_records(archive.records(ci, 29), 29))
    one = spark.createDataFrame([a], "file string, off long, size long")
    rows = archive.file_chunks(one, found, resolved, archive.bucket_records(spark, str(pool)), places).collect()
    assert len(rows) == 2 and all(r.needed and r.exact for r in rows)


def test_wrong_size_is_seen(spark, made):
    _, pool, lists, _ = made
    got = extracted(spark, pool, [(n, off, size + (n == "a")) for n, off, size in lists])
    assert not got["a"][0].exact and got["b"][0].exact


def test_a_flipped_byte_is_found(spark, made, tmp_path):
    import shutil

    _, pool, lists, expected = made
    shutil.copytree(pool, tmp_path / "1")
    place = tmp_path / "1/0/5.bucket.2"
    data = bytearray(place.read_bytes())
    data[3] ^= 1
    place.write_bytes(bytes(data))
    got = extracted(spark, tmp_path / "1", lists)
    assert got["a"][0].data is None and b"".join(bytes(r.data) for r in got["b"]) == expected["b"]


def test_unknown_layout_is_refused(spark, tmp_path):
    (tmp_path / "0.idx").write_bytes(header(31))
    with pytest.raises(archive.UnsupportedArchive):
        archive.record_size(archive.shards(spark, str(tmp_path)), "chunk_index")
    (tmp_path / "0.idx").write_bytes(b"short")
    with pytest.raises(archive.UnsupportedArchive):
        archive.record_size(archive.shards(spark, str(tmp_path)), "chunk_index")


def test_ranges_equal_one_blob(spark, monkeypatch):
    monkeypatch.setattr(archive, "MIB_8", 128)
    blob = bytes(range(256)) + bytes(10)
    rows = [(i, i * 128, blob[i * 128 : (i + 1) * 128]) for i in range(3)]
    found = spark.createDataFrame(rows, "n long, start long, data binary")
    reads = [(k, off, n) for k, (off, n) in enumerate((o, n) for o in (0, 1, 127, 128, 200, 255, 260, 300) for n in (0, 1, 2, 100, 200, 400))]
    frame = spark.createDataFrame(reads, "read long, off long, len long")
    for r in archive.ranges(frame, found).collect():
        assert bytes(r.data) == blob[r.off : r.off + r.len]
    gap = found.where("n <> 1")
    for r in archive.ranges(frame, gap).collect():
        end = 128 if r.off < 128 else 256 if r.off < 256 else 266
        start_in_gap = 128 <= r.off < 256
        assert bytes(r.data) == (b"" if start_in_gap else blob[r.off : min(r.off + r.len, end)])


def test_records_straddle_shards(spark, monkeypatch):
    monkeypatch.setattr(archive, "MIB_8", 100)
    stream = header(29) + b"".join(bytes([i]) * 29 for i in range(12)) + b"tail"
    rows = [(i, i * 100, stream[i * 100 : (i + 1) * 100]) for i in range(-(-len(stream) // 100))]
    got = archive.records(spark.createDataFrame(rows, "n long, start long, data binary"), 29).orderBy("key").collect()
    assert [(r.key, bytes(r.record)) for r in got] == [(64 + 29 * i, bytes([i]) * 29) for i in range(12)]


def test_a_full_shard_is_cut_once(spark):
    """Reads don't copy the shard that they lie in: 40,000 of them would copy 335 GB."""
    stream = header(29) + random.Random(3).randbytes(archive.MIB_8 - archive.HEADER)
    found = spark.createDataFrame([(0, 0, stream)], "n long, start long, data binary")
    began = time.monotonic()
    whole = [stream[at : at + 29] for at in range(64, len(stream) - 28, 29)]
    got = archive.records(found, 29).agg(F.count("*"), F.sum(F.col("key") % 1009 * F.crc32("record"))).first()
    assert tuple(got) == (len(whole), sum((64 + 29 * i) % 1009 * zlib.crc32(r) for i, r in enumerate(whole)))
    reads = spark.range(40_000).select(F.col("id").alias("read"), (F.col("id") * 209 + 5).alias("off"), (F.col("id") % 300).alias("len"))
    got = archive.ranges(reads, found).agg(F.sum(F.col("read") * F.crc32("data"))).first()[0]
    assert got == sum(i * zlib.crc32(stream[i * 209 + 5 : i * 209 + 5 + i % 300]) for i in range(40_000))
    assert time.monotonic() - began < 60


def test_a_list_of_many_keys(spark, made):
    """A list longer than a page comes back in order, every key once."""
    _, pool, _, _ = made
    keys = [64 + 29 * (i * 7 % 5) for i in range(3000)]
    stream = header(0) + bytes(12) + b"".join(struct.pack(">q", k) for k in keys)
    found = spark.createDataFrame([(0, 0, stream)], "n long, start long, data binary")
    ci = archive.shards(spark, f"{pool}/chunk_index.index")
    resolved = archive.resolved_chunks(archive.chunk_records(archive.records(ci, 29), 29))
    places = {r.key: (r.bucket, r.offset) for r in resolved.collect()}
    rows = archive.file_chunks(spark.createDataFrame([("long", 76, 10**6)], "file string, off long, size long"), found, resolved, archive.bucket_records(spark, str(pool))).orderBy("seq").collect()
    assert [(r.seq, r.bucket, r.offset) for r in rows] == [(i, *places[k]) for i, k in enumerate(keys)]


def test_a_long_file_is_cut_and_joined_once(spark, tmp_path):
    """A file of 8,192 chunks: a copy of the whole for each of them would move 268 GB to cut and half as much to join."""
    text = random.Random(4).randbytes(2**24).hex()
    pq.write_table(pa.table({"file": ["long", "none", "null"], "text": [text, "", None]}), tmp_path / "long.parquet")
    files = spark.read.parquet(str(tmp_path / "long.parquet")).select("file", F.col("text").cast("binary").alias("content"))
    began = time.monotonic()
    rows = split(files, "content", 4096).select("file", "seq", F.col("chunk").alias("data"))
    got = rows.groupBy("file").agg(F.count("*"), F.md5(F.expr(archives.JOINED))).collect()
    assert time.monotonic() - began < 40
    assert list(map(tuple, got)) == [("long", 8192, hashlib.md5(text.encode()).hexdigest())]


def test_a_lost_chunk_leaves_no_part_of_its_file(spark, tmp_path):
    """A file with a chunk that can't be read is not ok, and its other chunks aren't passed off as the file."""
    texts = [random.Random(6).randbytes(6000).hex(), "whole"]
    files = spark.createDataFrame([(str(i), t.encode()) for i, t in enumerate(texts)], "file string, content binary")
    lists = pack(files, str(tmp_path)).localCheckpoint()
    place = tmp_path / "Pool/1/0/0.bucket"
    index = (tmp_path / "Pool/1/0/0.index").read_bytes()
    records = [struct.unpack(">III", index[at : at + 12]) for at in range(archive.HEADER, len(index), 32)]
    data = bytearray(place.read_bytes())
    data[next(at for clen, at, ulen in records if ulen == 4096)] ^= 1
    place.write_bytes(bytes(data))
    got = archives._rebuilt(spark, str(tmp_path / "Pool/1"), lists, lists.select("off")).orderBy("file").collect()
    assert [(r.md5, r.ok) for r in got] == [(hashlib.md5(b"").hexdigest(), False), (hashlib.md5(b"whole").hexdigest(), True)]


def test_packing_keeps_bytes_out_of_tables(spark, tmp_path):
    """What is written beside the archive are digests and places; files that share chunks, or a name, store them once."""
    body = random.Random(5).randbytes(2**20)
    rows = [("a", body), ("b", body + b"tail"), ("c", body), ("d", random.Random(6).randbytes(2**22)), ("e", b""), ("f", body[:5000]), ("f", body[:5000])]
    files = spark.createDataFrame(rows, "file string, content binary")
    root = Path(shared_folder(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in root.rglob("*") if f.is_file())
    before = size()
    pack(files, str(tmp_path))
    assert size() - before < 2**20
    index = archive.bucket_records(spark, str(tmp_path / "Pool/1"))
    pieces = {c[i : i + 4096] for _, c in rows for i in range(0, len(c), 4096)}
    assert sorted(bytes(r.md5) for r in index.collect()) == sorted(hashlib.md5(p).digest() for p in pieces)


def test_sqlite_lists(spark, tmp_path):
    for share in ("a", "b"):
        (tmp_path / share).mkdir()
        db = sqlite3.connect(tmp_path / share / "1.db")
        db.execute("create table version_list (name text, size integer, id blob)")
        db.executemany("insert into version_list values (?, ?, ?)", [(f"{share}{i}", None if i == 2 else i, bytes([i])) for i in range(5)])
        db.commit()
        db.close()
    (tmp_path / "a/2.db").write_bytes(b"not a database at all, only some bytes" * 10)
    got = archive.sqlite_rows(spark, str(tmp_path), "select name, size, id from version_list", "name string, size bigint, id binary")
    rows = got.where("error is null").collect()
    assert sorted(r.name for r in rows) == [f"{s}{i}" for s in "ab" for i in range(5)] and sum(r.size is None for r in rows) == 2
    assert got.where("error is not null and path like '%a/2.db'").count() == 1


def test_manifest_and_settings(spark, tmp_path):
    log = tmp_path / "log"
    archive.append_manifest(str(log), [{"p": "x", "s": 1, "m": "a", "o": 5}, {"p": "y", "s": 2, "m": "b"}, {"p": "x", "void": 1}])
    with log.open("a") as f:
        f.write("\n" + json.dumps({"p": "z", "s": 3, "m": "c", "o": 7}) + '\n{"p": "y", "s":')
    rows = {r.p: r for r in archive.manifest(spark, str(log)).collect()}
    assert rows["x"].void == 1 and rows["x"].s is None and rows["y"].o is None and rows["z"].o == 7
    (tmp_path / "task").write_text('[a=b]\nname = "one"\nx=1=2\nname="two"\nplain\n')
    assert {r.key: r.value for r in archive.task_config(spark, str(tmp_path / "task")).collect()} == {"name": "two", "x": "1=2"}
