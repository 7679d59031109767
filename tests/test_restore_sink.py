import hashlib

import pytest

from vaultline.sources.restore import sweep_parts, write_files


def test_files_are_written_whole(spark, tmp_path):
    rows = [("/s/a b.txt", i, bytes([i]) * 1000, 7, 1_760_000_000) for i in range(50)] + [("/s/deep/x", 0, b"", 8, 0), ("/s/bad", 0, b"x", 9, 0), ("/s/bad", 1, None, 9, 0)]
    parts = spark.createDataFrame(rows, "path string, seq int, data binary, ovf long, mtime long").repartition(7)
    got = {r.p: r for r in write_files(parts, str(tmp_path)).collect()}
    whole = b"".join(bytes([i]) * 1000 for i in range(50))
    place = tmp_path / "s/a b.txt"
    assert place.read_bytes() == whole and place.stat().st_mtime == 1_760_000_000
    assert (got["/s/a b.txt"].s, got["/s/a b.txt"].m, got["/s/a b.txt"].o) == (50_000, hashlib.md5(whole).hexdigest(), 7)
    assert (tmp_path / "s/deep/x").read_bytes() == b"" and got["/s/bad"].error and not (tmp_path / "s/bad").exists()
    assert sweep_parts(str(tmp_path)) == 0
    (tmp_path / "s/old.part").write_bytes(b"")
    assert sweep_parts(str(tmp_path)) == 1


def test_paths_stay_inside(spark, tmp_path):
    parts = spark.createDataFrame([("/../out", 0, b"x", 1, 0)], "path string, seq int, data binary, ovf long, mtime long")
    with pytest.raises(Exception, match="leads out"):
        write_files(parts, str(tmp_path / "in")).collect()
