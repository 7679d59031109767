"""URL filters: rules first, else link-graph propagation of trust and distrust between hosts (operator 9).

DataFrame functions only. Trust is personalised PageRank that restarts at trusted hosts and follows links; distrust
restarts at blocked hosts and follows links backwards, to those who link there. A host is judged by both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written

#: (action, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z in lower case. Path: then up to ?, # or the end.

    A null url or one without :// has an empty host and path.
    """
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits: its host or a subdomain, with a path that starts with the rule's."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, h + p).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts in html, counted; pages of one host are summed before the shuffle."""
    src, _ = host_and_path(F.col("url"))
    dst = F.explode(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), lambda h: F.translate(h, UPPER, LOWER)))
    links = pages.where("html is not null").select(src.alias("src"), dst.alias("dst"))
    return links.where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """(kind, host, score) by personalised PageRank over edges (kind, src, dst, n), restarting at seeds (kind, host).

    Every seed restarts with a mass of 1, so that a host's scores come from the links that lead to it and not from how many
    other seeds there are. The mass of hosts without links falls away. Ends once no score moves by more than the tolerance;
    a round moves a kind's mass by 0.85 of the last one's at most. Raises if so many rounds don't do. Each round is written, which cuts lineage.
    """
    start = written(seeds.select("kind", "host", F.lit(1.0).alias("s")), "seeds")
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    step = written(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("w")), "steps")
    if step.isEmpty():
        return start.withColumnRenamed("s", "score")
    rank = start_rank = start.withColumnRenamed("s", "score")
    for _ in range(rounds):
        moved = rank.withColumnRenamed("host", "src").join(step, ["kind", "src"])
        moved = moved.select("kind", F.col("dst").alias("host"), (damping * F.col("score") * F.col("w")).alias("score"))
        back = start.select("kind", "host", ((1 - damping) * F.col("s")).alias("score"))
        new = written(moved.unionByName(back).groupBy("kind", "host").agg(F.sum("score").alias("score")), "rank")
        both = new.join(rank.withColumnRenamed("score", "was"), ["kind", "host"], "full")
        change = both.agg(F.max(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0]
        if rank is not start_rank:
            discard(rank)
        rank = new
        if (change or 0.0) < tolerance:
            return rank
    raise RuntimeError(f"scores still move by {change} after {rounds} rounds")


def judge(pages: DataFrame, rules=RULES, least: float = 1e-4) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of pages (page_id, url, html).

    Trusted seeds are the hosts with a page that a rule allows; blocked seeds those that a rule blocks as a whole (its path
    is `/`), if no page is allowed. Where no rule fits, the host's scores decide: block if distrust is over `least` and over trust,
    else allow, and so do equal scores. Null urls have empty host and path, fit no rule and are allowed; null html has no links.
    Very long html is searched for links as a whole. Repeated rows stay, other columns aren't read, an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "action": action})
    whole = [h + p for act, h, p in rules if act == "block" and p == "/"]
    found = rows.where("host <> ''").groupBy("host").agg(
        F.max(F.col("action") == "allow").alias("good"), F.max(F.col("rule").isin(whole) if whole else F.lit(False)).alias("bad")
    )
    found = written(found, "hosts")
    seeds = found.where("good").select(F.lit("trust").alias("kind"), "host")
    seeds = seeds.unionByName(found.where("bad and not coalesce(good, false)").select(F.lit("distrust").alias("kind"), "host"))
    edges = written(host_edges(pages), "links")
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n")
    both = both.unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    rank = propagate(both, seeds)
    pick = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k)
    scores = written(rank.groupBy("host").agg(pick("trust"), pick("distrust")), "scores")
    judged = rows.join(scores, "host", "left").na.fill(0.0, ["trust", "distrust"])
    own = F.when((F.col("distrust") > least) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    verdict = F.coalesce("action", own).alias("verdict")
    return judged.select("page_id", "host", "path", "rule", verdict, "trust", "distrust")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


#: For pages without links between hosts, as the given ones: there only rules and seeds decide.
OP9_SQL = """
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h),
s AS (SELECT host, bool_or(rule IN ('example.net/en/', 'org/fr/')) AS good, bool_or(rule = 'net/') AS bad FROM r WHERE host <> '' GROUP BY host)
SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN s.bad AND NOT coalesce(s.good, false) THEN 'block' ELSE 'allow' END AS verdict FROM r LEFT JOIN s USING (host)
"""
