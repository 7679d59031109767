"""Tree, path and selection queries. Region, nation, customer and order stand for directories, line items for files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import tree
from ..sources.storage import table


def _id(letter: str, column: str):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def _dirs(spark: SparkSession, sf: str, orders: bool = False, customer=None) -> DataFrame:
    r = table(spark, sf, "region").select(_id("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = table(spark, sf, "nation").select(_id("n", "n_nationkey").alias("id"), _id("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    name = F.col("c_name") if customer is None else customer
    c = table(spark, sf, "customer").select(_id("c", "c_custkey").alias("id"), _id("n", "c_nationkey").alias("parent"), name.alias("name"))
    out = r.unionByName(n).unionByName(c)
    if orders:
        o = table(spark, sf, "orders").select(_id("o", "o_orderkey").alias("id"), _id("c", "o_custkey").alias("parent"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("name"))
        out = out.unionByName(o)
    return out


def _orders_as_files(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"))
    size = F.floor("o_totalprice").cast("long")
    return table(spark, sf, "orders").select(_id("c", "o_custkey").alias("parent"), name.alias("name"), size.alias("size"))


def tree_paths(spark, sf):
    return tree.directories(_dirs(spark, sf)).select("id", "path", F.size("ancestors").cast("long").alias("depth"))


PATHS_CTE = """
nodes AS (
  SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent, r_name AS name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, {name} FROM customer{orders}),
walk AS (
  SELECT id, '/' || name AS path, 1::BIGINT AS depth, [id] AS ancestors FROM nodes WHERE parent IS NULL AND {keep}
  UNION ALL
  SELECT n.id, w.path || '/' || n.name, w.depth + 1, list_append(w.ancestors, n.id) FROM nodes n JOIN walk w ON n.parent = w.id WHERE {keep})
"""
_ORDERS = "\n  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'order_' || o_orderkey FROM orders"
_cte = lambda name="c_name", orders="", keep="true": "WITH RECURSIVE" + PATHS_CTE.format(name=name, orders=orders, keep=keep)
SIDECAR_NAME = "CASE WHEN c_custkey % 10 = 0 THEN '@eaDir' ELSE c_name END"


def tree_subtree_totals(spark, sf):
    size = F.floor("l_extendedprice").cast("long")
    files = table(spark, sf, "lineitem").select(_id("o", "l_orderkey").alias("parent"), F.concat(F.lit("line_"), F.col("l_linenumber").cast("string")).alias("name"), size.alias("size"))
    return tree.subtree_totals(_dirs(spark, sf, orders=True), files)


def tree_roots_by_size(spark, sf):
    totals = tree.subtree_totals(_dirs(spark, sf), _orders_as_files(spark, sf))
    roots = totals.where("id like 'r%'")  # a handful of roots
    whole = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.desc("size"), "id")).cast("long")
    return roots.select("id", "path", "size", "nfiles", rank.alias("rn"), F.sum("size").over(whole).alias("all_size"), F.sum("nfiles").over(whole).alias("all_files"))


def tree_children_sorted(spark, sf):
    isdir = (F.col("c_custkey") % 3 != 0).cast("int")
    nodes = table(spark, sf, "customer").select(F.col("c_nationkey").alias("parent"), isdir.alias("isdir"), F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("name"))
    return tree.children_sorted(nodes).withColumn("rn", F.col("rn").cast("long"))


def tree_sidecar_prune(spark, sf):
    name = F.when(F.col("c_custkey") % 10 == 0, "@eaDir").otherwise(F.col("c_name"))
    totals = tree.subtree_totals(_dirs(spark, sf, customer=name), _orders_as_files(spark, sf))
    return totals.where("id like 'n%'")


def subtree_files(spark, sf):
    paths = tree.file_paths(_dirs(spark, sf), _orders_as_files(spark, sf))
    return paths.where(F.array_contains("ancestors", F.lit("n7"))).select("path", "size")


def _documents(spark, sf) -> DataFrame:
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf, "documents").select(path.alias("path"), F.col("n_chars").alias("size"), "doc_id")


DOCS_CTE = "WITH d AS (SELECT '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, n_chars AS size, doc_id FROM documents)"


def glob_filter(spark, sf):
    return _documents(spark, sf).where(expr.path_filter(F.col("path"), "/src1*/en/*[05].txt")).select("path", "size")


def substring_filter(spark, sf):
    return _documents(spark, sf).where(expr.path_filter(F.col("path"), "C1/FR")).select("path", "size")


def name_search_topk(spark, sf):
    hits = table(spark, sf, "part").where(F.col("p_name").ilike("%blue%"))
    return hits.orderBy(F.desc("p_size"), "p_partkey").limit(1).select("p_partkey", "p_name", "p_size")


def list_first_200(spark, sf):
    line = F.concat(expr.grouped(F.col("size")), F.lit("  "), F.col("path"))
    return _documents(spark, sf).orderBy("path").limit(200).select(line.alias("line"))


def match_totals(spark, sf):
    hits = _documents(spark, sf).where(expr.glob_match(F.col("path"), "*/de/*"))
    return hits.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def _chosen(spark) -> DataFrame:
    return spark.createDataFrame([("n3",), ("c17",), ("c25",), ("r1",)], "id string")


def selection_state(spark, sf):
    return tree.selection_state(_dirs(spark, sf), _chosen(spark))


def selection_toggle(spark, sf):
    """Nation 1 unticked while its region is chosen: the region's other nations take its place."""
    return tree.toggle_off(_dirs(spark, sf), _chosen(spark), "n1")


def selection_totals(spark, sf):
    totals = tree.subtree_totals(_dirs(spark, sf), _orders_as_files(spark, sf))
    chosen = totals.join(tree.toggle_on(_dirs(spark, sf), _chosen(spark), "r0"), "id", "left_semi")
    return chosen.agg(F.count("*").alias("items"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("nfiles"), F.lit(0)).alias("files"))


def selection_all(spark, sf):
    """Everything selected, against nothing: items, bytes and files of both."""
    dirs = _dirs(spark, sf)
    totals = tree.subtree_totals(dirs, _orders_as_files(spark, sf))
    sums = [F.count("*").alias("items"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("nfiles"), F.lit(0)).alias("files")]
    part = lambda chosen, name: totals.join(chosen, "id", "left_semi").agg(*sums).select(F.lit(name).alias("selection"), "*")
    return part(tree.select_all(dirs), "all").unionByName(part(tree.select_none(dirs), "none"))


_TOTALS = """
SELECT w.id, w.path, CAST(coalesce(sum(f.size), 0) AS BIGINT) AS size, CAST(count(f.size) AS BIGINT) AS nfiles
FROM walk w LEFT JOIN (SELECT a.ancestor, f.size FROM (SELECT id, unnest(ancestors) AS ancestor FROM walk) a JOIN files f ON f.parent = a.id) f ON f.ancestor = w.id
GROUP BY w.id, w.path"""
_ORDER_FILES = "files AS (SELECT 'c' || o_custkey AS parent, CAST(floor(o_totalprice) AS BIGINT) AS size, 'order_' || o_orderkey AS name FROM orders)"
_CHOSEN = "chosen AS (SELECT unnest(['n3', 'c17', 'c25', 'r1']) AS id)"

QUERIES = {f.__name__: f for f in (
    tree_paths, tree_subtree_totals, tree_roots_by_size, tree_children_sorted, tree_sidecar_prune, subtree_files, glob_filter,
    substring_filter, name_search_topk, list_first_200, match_totals, selection_state, selection_toggle, selection_totals, selection_all,
)}

ORACLE_SQL = {
    "tree_paths": f"{_cte()} SELECT id, path, depth FROM walk",
    "tree_subtree_totals": f"""{_cte(orders=_ORDERS)},
        files AS (SELECT 'o' || l_orderkey AS parent, CAST(floor(l_extendedprice) AS BIGINT) AS size FROM lineitem) {_TOTALS}""",
    "tree_roots_by_size": f"""{_cte()}, {_ORDER_FILES}, t AS ({_TOTALS}), r AS (SELECT * FROM t WHERE id LIKE 'r%')
        SELECT id, path, size, nfiles, row_number() OVER (ORDER BY size DESC, id) AS rn, CAST(sum(size) OVER () AS BIGINT) AS all_size,
        CAST(sum(nfiles) OVER () AS BIGINT) AS all_files FROM r""",
    "tree_children_sorted": """WITH n AS (SELECT c_nationkey AS parent, CASE WHEN c_custkey % 3 <> 0 THEN 1 ELSE 0 END AS isdir,
        CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS name FROM customer)
        SELECT *, row_number() OVER (PARTITION BY parent ORDER BY isdir DESC, lower(name), name) AS rn FROM n""",
    "tree_sidecar_prune": f"{_cte(SIDECAR_NAME, keep='name <> ' + chr(39) + '@eaDir' + chr(39))}, {_ORDER_FILES}, t AS ({_TOTALS}) SELECT * FROM t WHERE id LIKE 'n%'",
    "subtree_files": f"{_cte()}, {_ORDER_FILES} SELECT w.path || '/' || f.name AS path, f.size FROM walk w JOIN files f ON f.parent = w.id WHERE list_contains(w.ancestors, 'n7')",
    "glob_filter": f"{DOCS_CTE} SELECT path, size FROM d WHERE path GLOB '/src1*/en/*[05].txt'",
    "substring_filter": f"{DOCS_CTE} SELECT path, size FROM d WHERE contains(lower(path), 'c1/fr')",
    "name_search_topk": "SELECT p_partkey, p_name, p_size FROM part WHERE p_name ILIKE '%blue%' ORDER BY p_size DESC, p_partkey LIMIT 1",
    "list_first_200": f"{DOCS_CTE} SELECT lpad(format('{{:,}}', size), 13, ' ') || '  ' || path AS line FROM d ORDER BY path LIMIT 200",
    "match_totals": f"{DOCS_CTE} SELECT count(*) AS n, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM d WHERE path GLOB '*/de/*'",
    "selection_state": f"""{_cte()}, {_CHOSEN}, up AS (SELECT DISTINCT unnest(ancestors) AS id FROM walk WHERE id IN (SELECT id FROM chosen)),
        over_ AS (SELECT DISTINCT a.id FROM (SELECT id, unnest(ancestors) AS x FROM walk) a WHERE a.x IN (SELECT id FROM chosen))
        SELECT id, CASE WHEN id IN (SELECT id FROM over_) THEN 'FULL' WHEN id IN (SELECT id FROM up) THEN 'PARTIAL' ELSE 'NONE' END AS state FROM walk""",
    "selection_toggle": f"""WITH {_CHOSEN} SELECT id FROM chosen WHERE id <> 'r1' AND id NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_nationkey = 1)
        UNION SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 1 AND n_nationkey <> 1""",
    "selection_all": f"""WITH {_ORDER_FILES} SELECT 'all' AS selection, (SELECT count(*) FROM region) AS items, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files
        FROM files WHERE parent IN (SELECT 'c' || c_custkey FROM customer) UNION ALL SELECT 'none', 0, 0, 0""",
    "selection_totals": f"""{_cte()}, {_CHOSEN}, {_ORDER_FILES}, t AS ({_TOTALS}), s AS (SELECT id FROM chosen
        WHERE id NOT IN (SELECT id FROM walk WHERE list_contains(ancestors, 'r0')) UNION SELECT 'r0')
        SELECT count(*) AS items, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, CAST(coalesce(sum(nfiles), 0) AS BIGINT) AS files FROM t WHERE id IN (SELECT id FROM s)""",
}
