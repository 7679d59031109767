"""Version, chunk-store, format and verification queries. Orders stand for versions; slices of document texts for chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codecs, expr
from ..operators import chunks, ordering, restore, versions
from ..sources.storage import table

CHUNK = 512


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "Complete").when(F.col("o_orderstatus") == "O", "Backingup").otherwise("Failure")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("timestamp"), status.alias("status"))


VERSIONS_CTE = """WITH v AS (SELECT o_orderkey AS id, CAST(epoch(o_orderdate) AS BIGINT) AS ts,
  CASE o_orderstatus WHEN 'F' THEN 'Complete' WHEN 'O' THEN 'Backingup' ELSE 'Failure' END AS status FROM orders)"""


def version_default(spark, sf):
    present = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    return versions.newest(versions.usable(_versions(spark, sf), present))


def version_asof(spark, sf):
    month = F.unix_timestamp(F.date_trunc("month", F.col("l_shipdate").cast("timestamp")))
    cutoffs = table(spark, sf, "lineitem").select(month.alias("cutoff")).distinct()
    return versions.latest_as_of(cutoffs, versions.usable(_versions(spark, sf)))


def version_share_presence(spark, sf):
    presence = table(spark, sf, "orders").select((F.col("o_orderkey") % 500).alias("id"), F.col("o_orderpriority").alias("share"))
    return versions.shares_of(presence)


def version_ids_union(spark, sf):
    a = table(spark, sf, "orders").select((F.col("o_custkey") * 3).alias("id"))
    b = table(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("id"))
    return a.union(b).distinct()


MOMENTS = ("2023-11-16", "2023-11-17", "2023-11-16 02:00", "2023-11-16 01:59", "2023-11-16T01:59:59", "2023-11-16 02:00:00", "2041-05-06", "2000-02-29", "yesterday", "2023-06-31", "  2023-11-16  ", "2023-11-16 2:00")


def moment_bounds(spark, sf):
    rows = spark.createDataFrame([(m,) for m in MOMENTS], "text string")
    bound = expr.moment_bound(F.col("text"))
    return rows.select("text", bound.alias("bound"), expr.when_text(bound).alias("local"), expr.iso_text(bound).alias("iso"))


def generation_latest(spark, sf):
    gen = F.col("doc_id") % 7
    base = F.concat("source", F.lit("-"), "lang")
    name = F.when(gen == 0, base).otherwise(F.concat(base, F.lit("."), gen.cast("string")))
    files = table(spark, sf, "documents").select(name.alias("file"))
    pattern = r"^(.*?)(?:\.(\d+))?$"
    parsed = files.select("file", F.regexp_extract("file", pattern, 1).alias("base"), F.coalesce(F.expr(r"nullif(regexp_extract(file, r'^(.*?)(?:\.(\d+))?$', 2), '')").cast("long"), F.lit(0)).alias("gen"))
    return parsed.groupBy("base").agg(F.max("gen").alias("gen"), F.max_by("file", "gen").alias("file"))


def _shards(spark, sf) -> DataFrame:
    return table(spark, sf, "part").where("p_size % 7 <> 0").select(F.col("p_brand").alias("family"), F.col("p_size").cast("long").alias("n")).distinct()


def shard_layout(spark, sf):
    return chunks.shard_layout(_shards(spark, sf), expr.MIB_8)


def shard_range_read(spark, sf):
    shards = _shards(spark, sf).withColumn("bytes", F.when(F.col("n") % 11 == 0, 1000).otherwise(expr.MIB_8).cast("long"))
    k = F.col("s_suppkey")
    reads = table(spark, sf, "supplier").select(k.alias("read"), F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string")).alias("family"), (k * 7654321 % (45 * expr.MIB_8)).alias("off"), F.lit(30_000_000).cast("long").alias("len"))
    return chunks.readable(reads, shards, expr.MIB_8)


def be_decode(spark, sf):
    v = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey"))
    data = F.concat(expr.to_be_i64(v), expr.to_be_i64(F.col("o_custkey") * 65537))
    rows = table(spark, sf, "orders").select("o_orderkey", data.alias("data"))
    return rows.select("o_orderkey", expr.be_i64(F.col("data"), 1).alias("signed"), expr.be_u32(F.col("data"), 13).alias("low"), expr.be_i32(F.col("data"), 5).alias("low_signed"))


def pointer_unpack(spark, sf):
    packed = F.shiftleft(F.col("o_custkey") % 1000, 48).bitwiseOR(F.col("o_orderkey"))
    family, offset = expr.pointer(F.col("packed"))
    return table(spark, sf, "orders").select(packed.alias("packed")).select("packed", family.alias("family"), offset.alias("offset"))


def bucket_address(spark, sf):
    bid = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("bid")
    return table(spark, sf, "lineitem").select(bid).distinct().select("bid", expr.bucket_path(F.col("bid")).alias("path"))


def _chunks(spark, sf) -> DataFrame:
    rows = chunks.split(table(spark, sf, "documents").select("doc_id", "source", "n_chars", "text"), "text", CHUNK)
    return rows.withColumns({"digest": F.md5("chunk"), "len": F.length("chunk").cast("long"), "place": F.col("doc_id") * 100_000 + F.col("seq")})


CHUNKS_CTE = """WITH s AS (SELECT doc_id, source, n_chars, text, unnest(generate_series(0, CAST(ceil(length(text) / 512.0) AS INTEGER) - 1)) AS seq FROM documents),
c AS (SELECT doc_id, source, n_chars, CAST(seq AS INTEGER) AS seq, substring(text, seq * 512 + 1, 512) AS chunk, md5(substring(text, seq * 512 + 1, 512)) AS digest,
  CAST(length(substring(text, seq * 512 + 1, 512)) AS BIGINT) AS len, doc_id * 100000 + seq AS place FROM s)"""


def chunk_split(spark, sf):
    return _chunks(spark, sf).select("doc_id", "seq", "digest", "len")


def chunk_dedup_index(spark, sf):
    return chunks.canonical(_chunks(spark, sf), "digest", "place")


def cite_chain(spark, sf):
    k = F.col("o_orderkey")
    cite = F.when(k % 997 == 5, k).when(k % 331 == 7, k + 10_000_000).when((k % 5 != 0) & (k > 0), k - F.when(k % 7 == 0, 20).otherwise(1))
    return chunks.follow(table(spark, sf, "orders").select(k.alias("key"), F.when(cite >= 0, cite).alias("cite")))


def chunk_prefix_sum(spark, sf):
    size = F.col("n_chars") - F.when(F.col("doc_id") % 9 == 0, 600).otherwise(0)
    rows = _chunks(spark, sf).select("doc_id", "seq", "len", F.greatest(size, F.lit(0)).alias("size"))
    return chunks.needed(rows, "doc_id", "size", "len").select("doc_id", "seq", "cum", "needed", "exact")


def file_rebuild_verify(spark, sf):
    all_ = _chunks(spark, sf)
    store = all_.groupBy("digest").agg(F.min("chunk").alias("chunk"))
    parts = all_.select("doc_id", "seq", "digest").join(store, "digest")
    made = chunks.rebuilt(parts, "doc_id", "chunk").select("doc_id", F.md5("content").alias("md5"))
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("recorded"))
    return docs.join(made, "doc_id", "left").select("doc_id", F.coalesce("md5", F.md5(F.lit(""))).alias("md5"), (F.coalesce("md5", F.md5(F.lit(""))) == F.col("recorded")).alias("ok"))


def dedup_stats(spark, sf):
    all_ = _chunks(spark, sf)
    owner = all_.groupBy("digest").agg(F.min_by("source", "place").alias("source"), F.first("len").alias("len"))
    logical = all_.groupBy("source").agg(F.sum("len").alias("logical"), F.count("*").alias("refs"))
    stored = owner.groupBy("source").agg(F.sum("len").alias("stored"), F.count("*").alias("chunks"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return logical.join(stored, "source", "left").select("source", "logical", "refs", zero("stored"), zero("chunks"))


def key_trial(spark, sf):
    keyed = lambda k: F.md5(F.concat("text", F.lit(f"|key{k}")))
    docs = table(spark, sf, "documents")
    digest = F.md5(F.concat("text", F.lit("|key"), (F.col("doc_id") % 5).cast("string")))
    return chunks.first_key(docs.select("doc_id", "text", digest.alias("digest")), [keyed(k) for k in (2, 0, 3)], "digest").select("doc_id", "key")


def codec_roundtrip(spark, sf):
    codecs.small_batches(spark)
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("plain"))
    kind = (F.col("doc_id") % 3).cast("int")
    packed = docs.select("doc_id", "plain", codecs.encoded(F.col("plain"), kind).alias("raw"))
    back = codecs.decoded(F.col("raw"), F.length("plain"), F.unhex(F.md5("plain")), F.col("doc_id") % 3 == 0)
    return packed.select("doc_id", F.md5(back).alias("md5"))


def crc_records(spark, sf):
    record = F.concat(expr.to_be_i64(F.col("l_orderkey")), expr.to_be_i64(F.col("l_partkey")), expr.to_be_i64(F.col("l_suppkey")), F.unhex(F.lpad(F.hex(F.col("l_linenumber").cast("long")), 8, "0")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.crc32(record).alias("crc"), F.length(record).cast("long").alias("bytes"))


def aes_names(spark, sf):
    key, iv = "0123456789abcdef0123456789abcdef", "000102030405060708090a0b0c0d0e0f"
    rows = table(spark, sf, "customer").select("c_custkey", codecs.aes_encrypted(F.col("c_name"), key, iv).alias("sealed"))
    broken = F.when(F.col("c_custkey") % 50 == 7, F.lit("AAAA")).otherwise(F.col("sealed"))
    return rows.select("c_custkey", codecs.aes_name(broken, key, iv).alias("name"))


def human_rate_hms(spark, sf):
    b = F.col("o_orderkey") * F.col("o_orderkey") * 1021 + 7
    return table(spark, sf, "orders").select("o_orderkey", expr.human(b).alias("human"), expr.rate(b).alias("rate"), expr.hms(F.col("o_orderkey") * 7).alias("hms"))


def safe_names_codecs(spark, sf):
    kind = F.when(F.col("page_id") % 6 < 5, F.col("page_id") % 6)
    return table(spark, sf, "pages").select("page_id", expr.safe_name(F.col("url")).alias("safe"), expr.codec_name(kind).alias("codec"), expr.ellipsis(F.col("url"), 24).alias("label"), expr.extension(F.col("url")).alias("ext"))


def cache_fingerprint(spark, sf):
    """The key of each archive's index: schema, root, encryption, and name, size and time of every list that it was built from."""
    orders = table(spark, sf, "orders").withColumns({"root": F.col("o_custkey") % 50, "at": F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))})
    entry = F.concat_ws(":", F.col("o_orderkey").cast("string"), F.floor("o_totalprice").cast("string"), F.col("at").cast("string"))
    prefix = F.concat(F.lit("schema=3|root="), F.col("root").cast("string"), F.lit("|enc="), (F.col("root") % 2 == 0).cast("string"))
    return restore.index_key(orders, "root", "o_orderkey", entry, F.floor(F.col("o_orderkey") / 4096), prefix)


def stale_cache(spark, sf):
    """Line items stand for cached indexes, parts for archives, of which every third is open at version 3."""
    version = F.when(F.col("l_linenumber") != 5, F.col("l_linenumber").cast("long"))
    name = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    cached = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("root"), version.alias("version"), name.alias("name"))
    present = table(spark, sf, "part").select(F.col("p_partkey").alias("root"), F.explode(F.sequence(F.lit(1).cast("long"), 1 + F.col("p_size") % 4)).alias("version"))
    keep = cached.where("version = 3").groupBy("root").agg(F.min("name").alias("keep"))
    current = table(spark, sf, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("root"), F.lit(3).cast("long").alias("version")).join(keep, "root", "left")
    return restore.stale(cached, present, current)


def slice_sample(spark, sf):
    files = table(spark, sf, "lineitem").where("l_extendedprice > 0").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    files = files.where("l_linestatus is not null").withColumn("ovf", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    first = files.groupBy("l_returnflag", "ovf").agg(F.count("*").alias("n"))
    return ordering.slice_sample(first, "l_returnflag", ["ovf"], 20).select("l_returnflag", "slice", "ovf")


def run_lengths(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("fine"))
    return ordering.run_lengths(e.withColumn("bad", ~F.col("fine")), ["user_id"], ["event_id"], "bad").groupBy("length").agg(F.count("*").alias("n"))


def worker_blocks(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", ((F.col("o_orderkey") * 7919) % 1_000_003).alias("ovf"))
    return ordering.worker_blocks(o, 8, "ovf", "o_orderkey").select("o_orderkey", "worker")


def doctor_report(spark, sf):
    """One row for each check, in one pass over a table each."""
    v = _versions(spark, sf).agg(F.count("*").alias("n"), F.sum((F.col("status") == "Complete").cast("long")).alias("whole"), F.countDistinct("timestamp").alias("times"))
    c = _chunks(spark, sf).agg(F.count("*").alias("n"), F.countDistinct("digest").alias("d"))
    bad = table(spark, sf, "documents").agg(F.sum((F.length("text") != F.col("n_chars")).cast("long")).alias("bad"), F.count("*").alias("n"))
    row = lambda df, name, ok, detail: df.select(F.lit(name).alias("name"), ok.alias("ok"), detail.alias("detail"))
    text = lambda *parts: F.concat(*[F.col(p).cast("string") if p.isidentifier() else F.lit(p) for p in parts])
    out = row(v, "versions", F.col("whole") > 0, text("whole", " of ", "n"))
    out = out.unionByName(row(v, "dates", F.col("times") > 1, text("times")))
    out = out.unionByName(row(c, "chunks", F.col("n") >= F.col("d"), text("d", " of ", "n")))
    return out.unionByName(row(bad, "sizes", F.col("bad") == 0, text("bad", " of ", "n")))


QUERIES = {f.__name__: f for f in (
    version_default, version_asof, version_share_presence, version_ids_union, moment_bounds, generation_latest, shard_layout, shard_range_read, be_decode,
    pointer_unpack, bucket_address, chunk_split, chunk_dedup_index, cite_chain, chunk_prefix_sum, file_rebuild_verify, dedup_stats, key_trial, codec_roundtrip,
    crc_records, aes_names, human_rate_hms, safe_names_codecs, cache_fingerprint, stale_cache, slice_sample, run_lengths, worker_blocks, doctor_report,
)}

_SHARDS = "sh AS (SELECT DISTINCT p_brand AS family, CAST(p_size AS BIGINT) AS n FROM part WHERE p_size % 7 <> 0)"

ORACLE_SQL = {
    "version_default": f"{VERSIONS_CTE} SELECT max(id) AS id FROM v WHERE status = 'Complete' AND id IN (SELECT l_orderkey FROM lineitem) HAVING max(id) IS NOT NULL",
    "version_asof": f"""{VERSIONS_CTE}, m AS (SELECT DISTINCT CAST(epoch(date_trunc('month', l_shipdate)) AS BIGINT) AS cutoff FROM lineitem)
        SELECT cutoff, arg_max(id, (ts, id)) AS id FROM m LEFT JOIN v ON v.ts <= m.cutoff AND status = 'Complete' GROUP BY cutoff""",
    "version_share_presence": "SELECT o_orderkey % 500 AS id, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS shares FROM orders GROUP BY 1",
    "version_ids_union": "SELECT o_custkey * 3 AS id FROM orders UNION SELECT c_custkey * 2 FROM customer",
    "moment_bounds": """WITH t AS (SELECT unnest([%s]) AS text), p AS (SELECT text, trim(text) AS s FROM t), b AS (SELECT text, CASE
        WHEN NOT regexp_full_match(s, '\\d{4}-\\d{2}-\\d{2}([ T]\\d{2}:\\d{2}(:\\d{2})?)?') THEN NULL
        WHEN length(s) = 10 THEN epoch(TRY_CAST(s AS TIMESTAMP)) + 86399
        WHEN length(s) = 16 THEN epoch(TRY_CAST(replace(s, 'T', ' ') || ':59' AS TIMESTAMP)) ELSE epoch(TRY_CAST(replace(s, 'T', ' ') AS TIMESTAMP)) END AS e FROM p)
        SELECT text, CAST(e AS BIGINT) AS bound, coalesce(strftime(make_timestamp(CAST(e AS BIGINT) * 1000000), '%%Y-%%m-%%d %%H:%%M:%%S'), '?') AS local,
        strftime(make_timestamp(CAST(e AS BIGINT) * 1000000), '%%Y-%%m-%%dT%%H:%%M:%%S+00:00') AS iso FROM b""" % ", ".join(f"'{m}'" for m in MOMENTS),
    "generation_latest": """WITH f AS (SELECT source || '-' || lang AS base, doc_id % 7 AS gen FROM documents)
        SELECT base, max(gen) AS gen, base || CASE WHEN max(gen) = 0 THEN '' ELSE '.' || max(gen) END AS file FROM f GROUP BY base""",
    "shard_layout": f"WITH {_SHARDS} SELECT family, n, n * 8388608 AS start, lead(n) OVER w AS next, coalesce(lead(n) OVER w - n - 1, 0) AS gap FROM sh WINDOW w AS (PARTITION BY family ORDER BY n)",
    "shard_range_read": f"""WITH {_SHARDS}, b AS (SELECT *, CASE WHEN n % 11 = 0 THEN 1000 ELSE 8388608 END AS bytes FROM sh),
        r AS (SELECT s_suppkey AS read, 'Brand#' || (s_suppkey % 25 + 1) AS family, s_suppkey * 7654321 % (45 * 8388608) AS off, CAST(30000000 AS BIGINT) AS len FROM supplier),
        t AS (SELECT *, unnest(generate_series(off // 8388608, (off + len - 1) // 8388608)) AS n FROM r),
        m AS (SELECT t.read, t.n, greatest(0, off - t.n * 8388608) AS a, least(8388608, off + len - t.n * 8388608) AS z, coalesce(b.bytes, 0) AS bytes FROM t LEFT JOIN b ON b.family = t.family AND b.n = t.n),
        h AS (SELECT *, greatest(0, least(z, bytes) - a) AS have, z - a AS want FROM m),
        o AS (SELECT *, coalesce(min(CASE WHEN have = want THEN 1 ELSE 0 END) OVER (PARTITION BY read ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS open FROM h)
        SELECT r.read, r.family, r.off, r.len, CAST(g.got AS BIGINT) AS got FROM r JOIN (SELECT read, sum(CASE WHEN open = 1 THEN have ELSE 0 END) AS got FROM o GROUP BY read) g USING (read)""",
    "be_decode": """WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -o_orderkey END AS s, (o_custkey * 65537) % 4294967296 AS low FROM orders)
        SELECT o_orderkey, s AS signed, CAST(low AS BIGINT) AS low, CAST(CASE WHEN s % 4294967296 >= 2147483648 THEN s % 4294967296 - 4294967296 ELSE s END AS INTEGER) AS low_signed FROM v""",
    "pointer_unpack": "SELECT (o_custkey % 1000) * 281474976710656 + o_orderkey AS packed, o_custkey % 1000 AS family, o_orderkey AS offset FROM orders",
    "bucket_address": "SELECT DISTINCT l_orderkey * 8 + l_linenumber AS bid, ((l_orderkey * 8 + l_linenumber) >> 11) || '/' || ((l_orderkey * 8 + l_linenumber) & 2047) AS path FROM lineitem",
    "chunk_split": f"{CHUNKS_CTE} SELECT doc_id, seq, digest, len FROM c",
    "chunk_dedup_index": f"{CHUNKS_CTE} SELECT digest, min(place) AS canonical, count(*) AS refs FROM c GROUP BY digest",
    "cite_chain": """WITH RECURSIVE r AS (SELECT k AS key, CASE WHEN c >= 0 THEN c END AS cite FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 997 = 5 THEN o_orderkey
          WHEN o_orderkey % 331 = 7 THEN o_orderkey + 10000000 WHEN o_orderkey % 5 <> 0 AND o_orderkey > 0 THEN o_orderkey - CASE WHEN o_orderkey % 7 = 0 THEN 20 ELSE 1 END END AS c FROM orders)),
        w AS (SELECT key, coalesce(cite, key) AS now, CASE WHEN cite IS NULL THEN 0 ELSE 1 END AS hops, cite IS NULL AS done FROM r
          UNION ALL SELECT w.key, coalesce(r.cite, w.now), w.hops + CASE WHEN r.cite IS NULL THEN 0 ELSE 1 END, r.cite IS NULL FROM w JOIN r ON r.key = w.now WHERE NOT w.done AND w.hops <= 16),
        l AS (SELECT key, max(hops) AS hops, bool_or(done) AS done, arg_max(now, hops * 2 + CASE WHEN done THEN 1 ELSE 0 END) AS final FROM w GROUP BY key)
        SELECT key, CASE WHEN done AND hops <= 16 THEN final END AS target, CAST(CASE WHEN done AND hops <= 16 THEN hops END AS INTEGER) AS hops,
          CASE WHEN hops > 16 THEN 'cite loop' WHEN NOT done AND final NOT IN (SELECT key FROM r) THEN 'missing' WHEN NOT done THEN 'cite loop' END AS error FROM l""",
    "chunk_prefix_sum": f"""{CHUNKS_CTE}, p AS (SELECT doc_id, seq, len, greatest(n_chars - CASE WHEN doc_id % 9 = 0 THEN 600 ELSE 0 END, 0) AS size,
        CAST(sum(len) OVER (PARTITION BY doc_id ORDER BY seq) AS BIGINT) AS cum FROM c)
        SELECT doc_id, seq, cum, cum - len < size AS needed, coalesce(max(CASE WHEN cum - len < size THEN cum END) OVER (PARTITION BY doc_id) = size, size = 0) AS exact FROM p""",
    "file_rebuild_verify": "SELECT doc_id, md5(text) AS md5, true AS ok FROM documents",
    "dedup_stats": f"""{CHUNKS_CTE}, o AS (SELECT digest, arg_min(source, place) AS source, any_value(len) AS len FROM c GROUP BY digest),
        l AS (SELECT source, CAST(sum(len) AS BIGINT) AS logical, count(*) AS refs FROM c GROUP BY source), st AS (SELECT source, CAST(sum(len) AS BIGINT) AS stored, count(*) AS chunks FROM o GROUP BY source)
        SELECT source, logical, refs, coalesce(stored, 0) AS stored, coalesce(chunks, 0) AS chunks FROM l LEFT JOIN st USING (source)""",
    "key_trial": "SELECT doc_id, CAST(CASE doc_id % 5 WHEN 2 THEN 0 WHEN 0 THEN 1 WHEN 3 THEN 2 END AS INTEGER) AS key FROM documents",
    "codec_roundtrip": "SELECT doc_id, md5(text) AS md5 FROM documents",
    "crc_records": """WITH t AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
          FROM (SELECT unnest(range(0, 256)) AS i)),
        r AS (SELECT l_orderkey, l_linenumber, [(l_orderkey >> 56) & 255] || list_transform(range(6, -1, -1), lambda k: (l_orderkey >> (8 * k)) & 255) || list_transform(range(7, -1, -1), lambda k: (l_partkey >> (8 * k)) & 255)
          || list_transform(range(7, -1, -1), lambda k: (l_suppkey >> (8 * k)) & 255) || list_transform(range(3, -1, -1), lambda k: (CAST(l_linenumber AS BIGINT) >> (8 * k)) & 255) AS b FROM lineitem)
        SELECT l_orderkey, l_linenumber, xor(list_reduce([4294967295::BIGINT] || b, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295::BIGINT) AS crc, CAST(len(b) AS BIGINT) AS bytes FROM r, t""",
    "aes_names": "SELECT c_custkey, CASE WHEN c_custkey % 50 = 7 THEN '<undecryptable:AAAA>' ELSE c_name END AS name FROM customer",
    "human_rate_hms": """WITH o AS (SELECT o_orderkey, o_orderkey * o_orderkey * 1021 + 7 AS b, o_orderkey * 7 AS s FROM orders) SELECT o_orderkey,
        CASE WHEN abs(b) < 1024 THEN format('{:.0f}B', b::DOUBLE) WHEN b < 1048576 THEN format('{:,.1f}K', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN format('{:,.1f}M', b / 1048576.0::DOUBLE)
          WHEN b < 1099511627776 THEN format('{:,.1f}G', b / 1073741824.0::DOUBLE) ELSE format('{:,.1f}T', b / 1099511627776.0::DOUBLE) END AS human,
        CASE WHEN b >= 1e7 THEN format('{:,.0f} MB/s', b / 1e6) WHEN b >= 1e6 THEN format('{:,.1f} MB/s', b / 1e6) WHEN b >= 1e3 THEN format('{:,.0f} KB/s', b / 1e3) ELSE format('{:,.0f} B/s', b::DOUBLE) END AS rate,
        CASE WHEN s >= 3600 THEN (s // 3600) || ':' ELSE '' END || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS hms FROM o""",
    "safe_names_codecs": r"""SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}\-._]', '_', 'g') AS safe,
        CASE page_id % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'lz4' WHEN 2 THEN 'lz4-hc' WHEN 4 THEN 'zlib' WHEN 3 THEN 'unknown(3)' ELSE '?' END AS codec,
        CASE WHEN length(url) > 24 THEN substring(url, 1, 23) || '…' ELSE url END AS label, CASE WHEN contains(url, '.') THEN lower(split_part(url, '.', -1)) ELSE '' END AS ext FROM pages""",
    "cache_fingerprint": """WITH b AS (SELECT o_custkey % 50 AS root, o_orderkey // 4096 AS block,
          sha1(string_agg(o_orderkey || ':' || CAST(floor(o_totalprice) AS BIGINT) || ':' || CAST(epoch(o_orderdate) AS BIGINT), '|' ORDER BY o_orderkey)) AS e FROM orders GROUP BY 1, 2)
        SELECT root, substring(sha1('schema=3|root=' || root || '|enc=' || (root % 2 = 0) || '|' || string_agg(e, '|' ORDER BY block)), 1, 16) AS fingerprint FROM b GROUP BY root""",
    "stale_cache": """WITH c AS (SELECT l_partkey AS root, CASE WHEN l_linenumber <> 5 THEN CAST(l_linenumber AS BIGINT) END AS version, l_orderkey || '-' || l_linenumber AS name FROM lineitem),
        k AS (SELECT root, min(name) AS keep FROM c WHERE version = 3 GROUP BY root)
        SELECT c.root, version, name FROM c JOIN part ON p_partkey = c.root AND p_partkey % 3 = 0 LEFT JOIN k ON k.root = c.root
        WHERE name IS DISTINCT FROM keep AND (version IS NULL OR version = 3 OR version > 1 + p_size % 4)""",
    "slice_sample": """WITH f AS (SELECT DISTINCT l_returnflag, l_orderkey * 8 + l_linenumber AS ovf FROM lineitem WHERE l_extendedprice > 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY ovf) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM f),
        k AS (SELECT *, least(20, n) AS k FROM r), s AS (SELECT *, ((i + 1) * k - 1) // n AS slice FROM k)
        SELECT l_returnflag, slice, ovf FROM s WHERE i = slice * n // k + ((slice + 1) * n // k - slice * n // k) // 2""",
    "run_lengths": """WITH e AS (SELECT user_id, event_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
        g AS (SELECT user_id, i - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e WHERE bad), l AS (SELECT user_id, k, count(*) AS length FROM g GROUP BY 1, 2)
        SELECT length, count(*) AS n FROM l GROUP BY length""",
    "worker_blocks": """WITH o AS (SELECT o_orderkey, (o_orderkey * 7919) % 1000003 AS ovf FROM orders), r AS (SELECT o_orderkey, row_number() OVER (ORDER BY ovf, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM o)
        SELECT o_orderkey, CAST(i // CAST(ceil(n / 8.0) AS BIGINT) AS INTEGER) AS worker FROM r""",
    "doctor_report": f"""{CHUNKS_CTE} SELECT 'versions' AS name, count(*) FILTER (o_orderstatus = 'F') > 0 AS ok, count(*) FILTER (o_orderstatus = 'F') || ' of ' || count(*) AS detail FROM orders
        UNION ALL SELECT 'dates', count(DISTINCT o_orderdate) > 1, count(DISTINCT o_orderdate)::VARCHAR FROM orders
        UNION ALL SELECT 'chunks', count(*) >= count(DISTINCT digest), count(DISTINCT digest) || ' of ' || count(*) FROM c
        UNION ALL SELECT 'sizes', count(*) FILTER (length(text) <> n_chars) = 0, count(*) FILTER (length(text) <> n_chars) || ' of ' || count(*) FROM documents""",
}
