"""Restore and progress queries. Events stand for progress messages and manifest records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import restore
from ..sources.restore import progress_rows
from ..sources.storage import table
from ..streaming.progress import counters_from_stream


def _kind():
    k = F.col("event_type")
    return F.when(k == "click", "P").when(k == "view", "O").when(k == "signup", "S").when(k == "error", "E").otherwise("D")


def _progress(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), _kind().alias("k"), F.floor(F.col("value") * 1000).cast("long").alias("b"), "user_id")


PROGRESS_CTE = """WITH p AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CASE event_type WHEN 'click' THEN 'P' WHEN 'view' THEN 'O' WHEN 'signup' THEN 'S' WHEN 'error' THEN 'E' ELSE 'D' END AS k,
  CAST(floor(value * 1000) AS BIGINT) AS b, user_id FROM events)"""
_COUNTERS = """SELECT count(*) FILTER (k = 'O') AS ok, count(*) FILTER (k = 'S') AS skipped, count(*) FILTER (k = 'E') AS failed,
  CAST(coalesce(sum(b) FILTER (k IN ('P', 'S')), 0) AS BIGINT) AS bytes_done FROM p"""


def manifest_last_wins(spark, sf):
    log = _progress(spark, sf).select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("p"), "event_id", F.when(F.col("k") != "E", F.col("b")).alias("s"))
    return restore.last_record(log, "p", "event_id").select("p", F.col("event_id").alias("record"), "s")


def resume_decision(spark, sf):
    k, total = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    size = F.when(k % 11 == 0, total + 1).when(k % 7 != 0, total)
    recorded = (F.col("o_custkey") % 3) != 0
    other = F.when(k % 5 != 0, k + (k % 4 == 0).cast("long"))
    rows = table(spark, sf, "orders").select("o_orderkey", total.alias("size"), size.alias("have"), recorded.alias("recorded"), other.alias("rec"), (k % 2 == 0).alias("md5"))
    plain, strict = (restore.decision(F.col("size"), F.col("have"), F.col("o_orderkey"), F.col("recorded"), F.col("rec"), F.col("md5"), s) for s in (False, True))
    return rows.select("o_orderkey", plain.alias("plain"), strict.alias("strict"))


def progress_counters(spark, sf):
    return restore.counters(_progress(spark, sf))


def progress_stream(spark, sf):
    return counters_from_stream(spark, sf, _kind())


def progress_recent(spark, sf):
    return restore.recent(_progress(spark, sf), ["event_id"]).select(F.col("rn").cast("long").alias("rn"), "event_id", "user_id")


def throughput_history(spark, sf):
    return restore.throughput(_progress(spark, sf))


def _worker_events(spark, sf) -> DataFrame:
    return _progress(spark, sf).select((F.col("user_id") % 300).alias("worker"), "k", F.col("event_id").cast("string").alias("message"))


def failed_workers(spark, sf):
    """Errors by worker; workers that never end get one more."""
    events = _worker_events(spark, sf)
    workers = events.select("worker").unionByName(spark.range(300, 305).select(F.col("id").alias("worker")))
    found = restore.with_failed_workers(events, workers).where("k = 'E'")
    return found.groupBy("worker").agg(F.count("*").alias("errors"), F.max("message").alias("message"))


def live_workers(spark, sf):
    return restore.live_workers(_progress(spark, sf).select((F.col("user_id") * 1000 + F.col("event_id") % 40).alias("worker"), "k"))


def error_report(spark, sf):
    errors = _progress(spark, sf).where("k = 'E'")
    return restore.error_report(errors, ["event_id"], F.concat_ws(": ", F.concat(F.lit("user"), F.col("user_id").cast("string")), F.col("event_id").cast("string")))


def progress_batches(spark, sf):
    """Document texts written in chunks of 512 characters, reported in batches of 2,048."""
    n = F.ceil(F.length("text") / 512).cast("int")
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.length("text").alias("size"), n.alias("n"))
    parts = docs.select("path", "size", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array(F.lit(0)))).alias("seq"))
    length = F.greatest(F.lit(0), F.least(F.lit(512), F.col("size") - F.col("seq") * 512))
    return progress_rows(parts.withColumn("length", length), 2048)


QUERIES = {f.__name__: f for f in (manifest_last_wins, resume_decision, progress_counters, progress_stream, progress_recent, throughput_history, failed_workers, live_workers, error_report, progress_batches)}

ORACLE_SQL = {
    "manifest_last_wins": f"{PROGRESS_CTE}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM p) SELECT 'user' || user_id AS p, event_id AS record, CASE WHEN k <> 'E' THEN b END AS s FROM l WHERE rn = 1",
    "resume_decision": """WITH o AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS size, o_custkey FROM orders),
        r AS (SELECT k, size, CASE WHEN k % 11 = 0 THEN size + 1 WHEN k % 7 <> 0 THEN size END AS have, o_custkey % 3 <> 0 AS rec, CASE WHEN k % 5 <> 0 THEN k + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END END AS o FROM o)
        SELECT k AS o_orderkey, CASE WHEN have IS NULL OR have <> size THEN 'extract' WHEN NOT rec THEN 'skip' WHEN o IS NULL OR o <> k THEN 'extract' ELSE 'skip' END AS plain,
        CASE WHEN have IS NULL OR have <> size THEN 'extract' WHEN NOT rec THEN 'extract' WHEN o IS NULL OR o <> k THEN 'extract' WHEN k % 2 = 0 THEN 'skip' ELSE 'extract' END AS strict FROM r""",
    "progress_counters": f"{PROGRESS_CTE} {_COUNTERS}",
    "progress_stream": f"{PROGRESS_CTE} {_COUNTERS}",
    "progress_recent": f"{PROGRESS_CTE} SELECT row_number() OVER (ORDER BY event_id DESC) AS rn, event_id, user_id FROM p WHERE k = 'O' ORDER BY event_id DESC LIMIT 15",
    "throughput_history": f"""{PROGRESS_CTE}, t AS (SELECT ts // 3600 * 3600 AS bucket, CAST(sum(b) AS BIGINT) AS bytes FROM p WHERE k IN ('P', 'S') GROUP BY 1)
        SELECT bucket, bytes, lag(bytes) OVER (ORDER BY bucket) AS previous, CAST(sum(bytes) OVER (ORDER BY bucket) AS BIGINT) AS done,
        CASE WHEN sum(bytes) OVER () = 0 THEN 100 ELSE CAST(floor(100 * sum(bytes) OVER (ORDER BY bucket) / sum(bytes) OVER ()) AS BIGINT) END AS pct,
        CASE WHEN sum(bytes) OVER (ORDER BY bucket) > 0 THEN CAST(floor((sum(bytes) OVER () - sum(bytes) OVER (ORDER BY bucket)) * (bucket + 3600 - min(bucket) OVER ())
          / sum(bytes) OVER (ORDER BY bucket)) AS BIGINT) ELSE 0 END AS eta FROM t""",
    "failed_workers": f"""{PROGRESS_CTE}, e AS (SELECT user_id % 300 AS worker, k, event_id::VARCHAR AS message FROM p),
        w AS (SELECT DISTINCT worker FROM e UNION SELECT unnest(range(300, 305))),
        x AS (SELECT worker, message FROM e WHERE k = 'E' UNION ALL SELECT worker, 'worker ended without reporting' FROM w WHERE worker NOT IN (SELECT worker FROM e WHERE k = 'D'))
        SELECT worker, count(*) AS errors, max(message) AS message FROM x GROUP BY worker""",
    "live_workers": f"""{PROGRESS_CTE}, w AS (SELECT user_id * 1000 + event_id % 40 AS worker, bool_or(k = 'D') AS ended FROM p GROUP BY 1) SELECT count(*) FILTER (NOT ended) AS live FROM w""",
    "error_report": f"""{PROGRESS_CTE}, e AS (SELECT row_number() OVER (ORDER BY event_id) AS rn, 'user' || user_id || ': ' || event_id AS t FROM p WHERE k = 'E')
        SELECT rn, '  failed: ' || t AS line FROM e WHERE rn <= 20 UNION ALL SELECT 21, '  and ' || format('{{:,}}', max(rn) - 20) || ' more' FROM e HAVING max(rn) > 20""",
    "progress_batches": """WITH d AS (SELECT doc_id::VARCHAR AS p, length(text) AS size FROM documents WHERE text IS NOT NULL),
        b AS (SELECT p, size, unnest(range(0, (size + 2047) // 2048)) AS i FROM d)
        SELECT 'P' AS k, p, CAST(least(2048, size - i * 2048) AS BIGINT) AS b FROM b UNION ALL SELECT 'O', p, 0 FROM d""",
}
