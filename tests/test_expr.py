"""Expressions against Python's own results."""

import fnmatch
import zlib

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vaultline.functions import codecs, expr

PATHS = ["/src1/en/10.txt", "/a/b c", "/x[1].txt", "/x1.txt", "/x\n1.txt", "/é^z", "/a-b", "/]", "/", "/a&b&&c", "/A.TXT", "/a\\b", "/{x}", "/a(b)", "/$^"]
PATTERNS = ["*", "/src1*/en/*[05].txt", "/x[[]1].txt", "/x[!1].txt", "/x?1.txt", "/[]]", "/[!]]*", "/a[a-", "/a[&-]*", "/[^é]*", "*.txt", "/a[\\]b", "/[z-a]", "/{x}", "/a(b)", "/[!z-a]", "/[$]^", ""]


def test_glob_equals_fnmatch(spark):
    rows = spark.createDataFrame([(p,) for p in PATHS], "p string")
    got = rows.select("p", *[expr.glob_match(F.col("p"), g).alias(str(i)) for i, g in enumerate(PATTERNS)]).collect()
    for r in got:
        for i, g in enumerate(PATTERNS):
            assert r[str(i)] == fnmatch.fnmatchcase(r.p, g), (r.p, g)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab*?[]!-^&", max_size=8))
def test_random_globs(spark, pattern):
    texts = ["", "a", "b", "ab", "a-b", "[a]", "!", "^", "aab", "-", "]", "&"]
    rows = spark.createDataFrame([(p,) for p in texts], "p string")
    got = {r.p: r.m for r in rows.select("p", expr.glob_match(F.col("p"), pattern).alias("m")).collect()}
    assert got == {t: fnmatch.fnmatchcase(t, pattern) for t in texts}


def one(spark, column, kind="string"):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("value", "text"), [(167000, "167 KB/s"), (1.2e6, "1.2 MB/s"), (106e6, "106 MB/s"), (0, "0 B/s"), (None, "0 B/s"), (12345678901, "12,346 MB/s")])
def test_rate(spark, value, text):
    assert one(spark, expr.rate(F.lit(value).cast("double"))) == text


def test_formatting(spark):
    assert [one(spark, expr.human(F.lit(n).cast("long"))) for n in (None, 0, -5000, -12, 1023, 1024, 1536, 5 * 2**40, 3000 * 2**40)] == ["0B", "0B", "-4.9K", "-12B", "1023B", "1.0K", "1.5K", "5.0T", "3,000.0T"]
    assert [one(spark, expr.hms(F.lit(n).cast("double"))) for n in (None, -5, 59.9, 61, 3600, 360000)] == ["--:--", "00:00", "00:59", "01:01", "1:00:00", "100:00:00"]
    assert one(spark, expr.hms(F.lit(float("nan")))) == "--:--"
    assert [one(spark, expr.safe_name(F.lit(n))) for n in ("a b/ü.1", "", None)] == ["a_b_ü.1", "archive", "archive"]
    assert one(spark, expr.ellipsis(F.lit("x" * 45))) == "x" * 43 + "…" and one(spark, expr.ellipsis(F.lit("x" * 44))) == "x" * 44
    assert [one(spark, expr.extension(F.lit(n))) for n in ("a.TAR.Gz", "none")] == ["gz", ""]
    assert [one(spark, expr.codec_name(F.lit(n))) for n in ("0", "4", "9", None)] == ["none", "zlib", "unknown(9)", "?"]
    assert one(spark, expr.grouped(F.lit(1234567))) == "    1,234,567"


def test_days_of_23_and_25_hours(spark):
    import datetime
    from zoneinfo import ZoneInfo

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Warsaw")
    try:
        for day in ("2026-03-29", "2026-10-25", "2026-06-01"):
            end = datetime.datetime.fromisoformat(day + "T23:59:59").replace(tzinfo=ZoneInfo("Europe/Warsaw"))
            assert one(spark, expr.moment_bound(F.lit(day))) == int(end.timestamp())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_binary_fields(spark):
    for v in (0, 1, -1, 2**62, -(2**63), 2**63 - 1):
        assert one(spark, expr.be_i64(F.lit(v.to_bytes(8, "big", signed=True)), 1)) == v
    assert one(spark, expr.be_u32(F.lit(bytes.fromhex("007053A86E")), 2)) == 0x7053A86E
    assert one(spark, expr.be_i32(F.lit(b"\xff\xff\xff\xfe"), 1)) == -2
    family, offset = expr.pointer(F.lit((3 << 48) | 12345))
    assert (one(spark, family), one(spark, offset)) == (3, 12345)
    assert [bool(one(spark, expr.is_directory(F.lit(m).cast("int")))) for m in (0o40755, 0o100644, None)] == [True, False, False]
    for data, plain in ((b"abc" + b"\x05" * 5, b"abc"), (b"abc", b"abc"), (b"\x10" * 16, b""), (b"ab\x02", b"ab\x02"), (b"a\x00", b"a\x00"), (b"\x11" * 17, b"\x11" * 17)):
        assert bytes(one(spark, expr.unpadded(F.lit(data)))) == plain


def test_decoding_order():
    import hashlib

    plain = b"some bytes " * 40
    md5 = hashlib.md5(plain).digest()
    for raw in (plain, zlib.compress(plain), pa.Codec("lz4_raw").compress(plain).to_pybytes()):
        assert codecs.decode_chunk(raw, len(plain), md5, False) == plain
    assert codecs.decode_chunk(b"other", 5, md5, False) is None
    stored = zlib.compress(b"x" * 100)  # a stored chunk that is itself a zlib stream
    assert codecs.decode_chunk(stored, len(stored), hashlib.md5(stored).digest(), True) == stored
    assert codecs.decode_chunk(stored, len(stored), hashlib.md5(stored).digest(), False) == stored
    assert codecs.decode_chunk(stored, len(stored), None, True) == stored


def test_codec_batches_stay_small(spark):
    """Codecs see no batch over 8 MB and a row, however large the table; each row comes back whole."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.unset(name)
    codecs.small_batches(spark)
    rows = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 100 != 7, F.repeat(F.md5(F.col("id").cast("string")), 320).cast("binary")).alias("plain"))

    @F.arrow_udf("long")
    def batch(plain: pa.Array) -> pa.Array:
        return pa.array([plain.nbytes] * len(plain), pa.int64())

    most = rows.select(batch("plain").alias("n")).agg(F.max("n")).first()[0]
    raw = codecs.encoded("plain", (F.col("id") % 3).cast("int"))
    back = codecs.decoded(raw, F.length("plain"), F.unhex(F.md5("plain")), F.col("id") % 3 == 0)
    wrong = rows.select("plain", back.alias("back")).where("not plain <=> back").count()
    spark.conf.set(name, before)
    assert most < 9_000_000 and wrong == 0
