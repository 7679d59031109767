from vaultline.sources import layout


def test_layout(spark, tmp_path):
    for name in ("a/x.arc/Config/@Share/one/1.db", "a/x.arc/Config/@Share/one/2.db", "a/x.arc/Config/@Share/one/2.db.3", "a/x.arc/Config/@Share/two/2.db", "a/x.arc/Config/@Share/two/complete_list.db",
                 "a/x.arc/Config/@Share/two/._9.db", "a/x.arc/Pool/10/0/1.bucket", "a/x.arc/Pool/2/0/1.bucket", "b/Config/only.txt", "c/thing", "c/thing.1", "c/thing.5", "c/thing.2", "c/._thing.9", "c/thing.bak"):
        place = tmp_path / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text(name)
    files = layout.listing(spark, str(tmp_path))
    assert [r.root for r in layout.archives(files).collect()] == [f"{tmp_path}/a/x.arc"]
    assert sorted(map(tuple, layout.share_versions(files).collect())) == [("one", 1), ("one", 2), ("two", 2)]
    assert sorted(r.pool for r in layout.pools(files).collect()) == [2, 10]
    newest = {r.base.rsplit("/", 1)[1]: (r.gen, r.path.rsplit("/", 1)[1]) for r in layout.generations(files).where("path like '%/c/%'").collect()}
    assert newest == {"thing": (5, "thing.5"), "thing.bak": (0, "thing.bak")}


def test_version_lines(spark):
    versions = spark.createDataFrame([(4, 1_700_100_000, "Complete"), (6, None, None), (9, 1_700_125_200, "")], "id long, timestamp long, status string")
    presence = spark.createDataFrame([(4, "photos"), (4, "mail"), (9, "mail")], "id long, share string")
    lines = [r.line for r in layout.version_lines(versions, presence).orderBy("id").collect()]
    assert lines == ["4\t2023-11-16T02:00:00+00:00\t1700100000\tComplete\tmail,photos", "6\t-\t-\t-\t-", "9\t2023-11-16T09:00:00+00:00\t1700125200\t-\tmail"]
