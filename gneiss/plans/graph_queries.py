"""Graph and impact queries on the projected driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import graph, impact
from gneiss.sources import fixtures as fx
from gneiss.sources.tables import table

QUERIES, ORACLE = {}, {}
W = "WITH " + fx.SQL


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(W + "SELECT DISTINCT l.dst AS node_key, l.src AS other_key, n.name, n.kind FROM links l JOIN nodes n ON n.node_key = l.src WHERE link_type NOT IN ('lexical_parent','lexical_owner')")
def graph_incoming(spark, d):
    return graph.neighbours(fx.nodes(spark, d), fx.links(spark, d))


@query(W + "SELECT DISTINCT l.src AS node_key, l.dst AS other_key, n.name, n.kind FROM links l JOIN nodes n ON n.node_key = l.dst WHERE link_type NOT IN ('lexical_parent','lexical_owner')")
def graph_outgoing(spark, d):
    return graph.neighbours(fx.nodes(spark, d), fx.links(spark, d), incoming=False)


@query(W + "SELECT DISTINCT l.dst AS node_key, l.src AS other_key, n.name, n.kind, l.link_type FROM links l JOIN nodes n ON n.node_key = l.src")
def graph_incoming_relations(spark, d):
    return graph.neighbours(fx.nodes(spark, d), fx.links(spark, d), typed=True)


@query(W + "SELECT DISTINCT l.src AS node_key, l.dst AS other_key, n.name, n.kind, l.link_type FROM links l JOIN nodes n ON n.node_key = l.dst")
def graph_outgoing_relations(spark, d):
    return graph.neighbours(fx.nodes(spark, d), fx.links(spark, d), incoming=False, typed=True)


@query(W + "SELECT node_key, count(*) AS degree FROM (SELECT src AS node_key FROM links UNION ALL SELECT dst FROM links WHERE dst <> src) GROUP BY 1")
def graph_degree_once(spark, d):
    return graph.degree_once(fx.links(spark, d))


@query(W + "SELECT n.node_key, count(e.k) AS degree FROM nodes n LEFT JOIN (SELECT src AS k FROM links UNION ALL SELECT dst FROM links) e ON e.k = n.node_key GROUP BY 1")
def graph_degree_ends(spark, d):
    return graph.degree_ends(fx.nodes(spark, d), fx.links(spark, d))


@query(W + """, deg AS (SELECT node_key, count(*) AS degree FROM (SELECT src AS node_key FROM links UNION ALL SELECT dst FROM links WHERE dst <> src) GROUP BY 1),
r AS (SELECT n.name, n.node_key, row_number() OVER (PARTITION BY n.name ORDER BY (contains(lower(path),'test') OR contains(lower(path),'spec')), coalesce(degree,0) DESC, n.node_key) AS i
 FROM nodes n LEFT JOIN deg USING (node_key))
SELECT p.wanted, r.node_key FROM (SELECT DISTINCT p_name AS wanted FROM part) p JOIN r ON r.name = p.wanted AND i = 1""")
def graph_find_by_name(spark, d):
    return graph.find_by_name(fx.nodes(spark, d), fx.links(spark, d), table(spark, d, "part").select(F.col("p_name").alias("wanted")))


@query(W + """, deg AS (SELECT node_key, count(*) AS degree FROM (SELECT src AS node_key FROM links UNION ALL SELECT dst FROM links WHERE dst <> src) GROUP BY 1)
SELECT upper(r_name) || '-none' AS wanted, ''::VARCHAR AS node_key FROM region WHERE 1=0
UNION ALL SELECT w.wanted, (SELECT n.node_key FROM nodes n LEFT JOIN deg USING (node_key) WHERE contains(lower(n.name), lower(w.wanted))
 ORDER BY (contains(lower(path),'test') OR contains(lower(path),'spec')), coalesce(degree,0) DESC, n.node_key LIMIT 1) AS node_key
FROM (SELECT DISTINCT substr(p_name, 2, 4) AS wanted FROM part) w""")
def graph_find_like(spark, d):
    return graph.find_by_name(fx.nodes(spark, d), fx.links(spark, d), table(spark, d, "part").select(F.substring("p_name", 2, 4).alias("wanted")))


@query(W + "SELECT node_key, name FROM nodes WHERE node_key = 'customer/1' OR (node_key >= 'customer/1#' AND node_key < 'customer/1$')")
def graph_key_range(spark, d):
    return graph.key_range(fx.nodes(spark, d), "customer/1").select("node_key", "name")


@query(W + "SELECT l.* FROM links l WHERE l.src IN (SELECT node_key FROM nodes WHERE kind='file') AND l.dst IN (SELECT node_key FROM nodes WHERE kind='file')")
def graph_prune_orphans(spark, d):
    return graph.prune_orphans(fx.nodes(spark, d).where("kind = 'file'"), fx.links(spark, d))


@query(W + "SELECT DISTINCT l.* FROM links l WHERE l.dst IN (SELECT node_key FROM nodes WHERE node_key LIKE 'part/%') AND l.src NOT IN (SELECT node_key FROM nodes WHERE node_key LIKE 'part/%')")
def graph_external_incoming(spark, d):
    return graph.external_incoming(fx.links(spark, d), fx.nodes(spark, d).where(F.col("node_key").startswith("part/")))


@query(W + """, f AS (SELECT node_key FROM nodes WHERE kind='file'), g AS (SELECT count(*) AS c FROM links WHERE src IN (FROM f) AND dst IN (FROM f))
SELECT (SELECT count(*) FROM f) AS nodes_loaded, g.c AS edges_loaded, (SELECT count(*) FROM links) - g.c AS edges_dropped FROM g""")
def graph_bulk_load(spark, d):
    return graph.bulk_load(fx.nodes(spark, d).where("kind = 'file'"), fx.links(spark, d))


@query(W + "SELECT count(*) AS total, count(*) FILTER (coalesce(description,'') <> '') AS described FROM nodes")
def graph_coverage(spark, d):
    return graph.coverage(fx.nodes(spark, d))


@query(W + "SELECT kind, count(*) AS n FROM nodes GROUP BY 1")
def graph_counts(spark, d):
    return fx.nodes(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(W + "SELECT node_key, name FROM nodes WHERE coalesce(name,'') <> '' ORDER BY node_key LIMIT 20")
def graph_canary(spark, d):
    return graph.canary(fx.nodes(spark, d))


@query(W + """, g AS (SELECT array_to_string(list_slice(string_split(path,'/'),1,least(2,len(string_split(path,'/'))-1)),'/') AS label, count(*) AS n, min(node_key) AS k FROM nodes GROUP BY 1)
SELECT row_number() OVER (ORDER BY k) - 1 AS group_id, label, n FROM g""")
def graph_groups(spark, d):
    return graph.groups(fx.nodes(spark, d))


@query(W + """SELECT a.path AS source, b.path AS target, link_type, count(*) AS n FROM links l JOIN nodes a ON a.node_key=l.src JOIN nodes b ON b.node_key=l.dst
WHERE link_type NOT IN ('contains','lexical_parent','lexical_owner') AND a.path <> b.path GROUP BY 1,2,3""")
def graph_collapsed(spark, d):
    return graph.collapse_to_files(fx.nodes(spark, d), fx.links(spark, d))


@query(W + """SELECT n.node_key AS id, n.name AS label, array_to_string(list_slice(string_split(path,'/'),1,least(2,len(string_split(path,'/'))-1)),'/') AS group_label, count(e.k) AS degree
FROM nodes n LEFT JOIN (SELECT src AS k FROM links UNION ALL SELECT dst FROM links) e ON e.k = n.node_key GROUP BY 1,2,3""")
def graph_topology(spark, d):
    return graph.topology(fx.nodes(spark, d), fx.links(spark, d))


@query("SELECT concat('supplier/', l_suppkey) AS node_key, list_sort(list(DISTINCT p_brand)) AS tags FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY 1")
def graph_tags(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    return graph.tag_lists(li.join(p, li.l_partkey == p.p_partkey).select(F.concat(F.lit("supplier/"), "l_suppkey").alias("node_key"), F.col("p_brand").alias("tag")))


@query("""SELECT row_id, CASE WHEN a=1 THEN base WHEN b=1 THEN base||'@L'||line ELSE base||'@L'||line||'#'||b END AS node_key FROM (
SELECT p_partkey AS row_id, p_name AS base, p_size AS line, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS a, row_number() OVER (PARTITION BY p_name, p_size ORDER BY p_partkey) AS b FROM part)""")
def graph_disambiguate(spark, d):
    return graph.disambiguate(table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("base"), F.col("p_size").alias("line")))


_SPANS = """s AS (SELECT o_custkey AS path, concat('o', o_orderkey) AS symbol, (o_orderkey % 97)::INT AS start_line, (o_orderkey % 97 + 1 + o_orderkey % 13)::INT AS end_line FROM orders),
p AS (SELECT l_orderkey*10+l_linenumber AS point_id, o_custkey AS path, l_quantity::INT AS line FROM lineitem JOIN orders ON o_orderkey=l_orderkey)"""


@query("WITH " + _SPANS + """, h AS (SELECT point_id, p.path, symbol, end_line-start_line AS size, min(end_line-start_line) OVER (PARTITION BY point_id) AS m
 FROM p LEFT JOIN s ON s.path=p.path AND line BETWEEN start_line AND end_line)
SELECT point_id, path, CASE WHEN count(symbol)=1 THEN max(symbol) ELSE path::VARCHAR END AS symbol FROM h WHERE symbol IS NULL OR size=m GROUP BY 1,2""")
def graph_innermost(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    k = F.col("o_orderkey")
    spans = o.select(F.col("o_custkey").cast("string").alias("path"), F.concat(F.lit("o"), k).alias("symbol"), (k % 97).cast("int").alias("start_line"), (k % 97 + 1 + k % 13).cast("int").alias("end_line"))
    points = li.join(o, li.l_orderkey == o.o_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"), F.col("o_custkey").cast("string").alias("path"), F.col("l_quantity").cast("int").alias("line")
    )
    return graph.innermost(spans, points)


_RISK = """CASE WHEN {c} >= greatest(21, floor(21.0*sqrt({t}/16000.0)+0.5)) THEN 'CRITICAL' WHEN {c} >= greatest(6, floor(6.0*sqrt({t}/16000.0)+0.5)) THEN 'HIGH' WHEN {c} >= 1 THEN 'MEDIUM' ELSE 'LOW' END"""


@query(W + ", r AS (SELECT n.node_key, count(DISTINCT l.src) AS c, (SELECT count(*) FROM nodes) AS t FROM nodes n LEFT JOIN links l ON l.dst=n.node_key GROUP BY 1) SELECT node_key, c AS dependents, " + _RISK.format(c="c", t="t") + " AS risk FROM r")
def impact_risk_levels(spark, d):
    return impact.risk_levels(fx.nodes(spark, d), fx.links(spark, d))


@query(W + ", top AS (SELECT dst FROM links WHERE link_type='calls' GROUP BY 1 ORDER BY count(DISTINCT src) DESC, dst LIMIT 1), r AS (SELECT DISTINCT dst AS target, src AS dependent FROM links WHERE dst IN (FROM top)), n AS (SELECT count(*) AS total FROM r) SELECT target, dependent, total, " + _RISK.format(c="total", t="(SELECT count(*) FROM nodes)") + " AS risk FROM r, n")
def impact_top_target(spark, d):
    return impact.top_targets(fx.nodes(spark, d), fx.links(spark, d))


@query(W + "SELECT DISTINCT dst AS target, src AS dependent FROM links")
def impact_blast_radius(spark, d):
    return impact.blast_radius(fx.links(spark, d))


@query("""SELECT DISTINCT concat('customer/', o_custkey) AS file, concat('part/', l_partkey) AS dependent FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def impact_file_rollup(spark, d):
    calls = fx.links(spark, d).where("link_type = 'calls'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "link_type")
    return impact.file_rollup(fx.nodes(spark, d), fx.links(spark, d).where("link_type = 'contains'").unionByName(calls))


@query(W + """SELECT DISTINCT c.dst AS symbol, n.name FROM links c JOIN (SELECT o_custkey, concat('customer/', o_custkey) AS f, concat('supplier/', l_suppkey) AS u FROM orders JOIN lineitem ON l_orderkey=o_orderkey) x ON x.f=c.src JOIN nodes n ON n.node_key=x.u WHERE c.link_type='contains'""")
def impact_container(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    uses = o.join(li, o.o_orderkey == li.l_orderkey).select(F.concat(F.lit("supplier/"), "l_suppkey").alias("src"), F.concat(F.lit("customer/"), "o_custkey").alias("dst"), F.lit("calls").alias("link_type"))
    return impact.container_dependents(fx.nodes(spark, d), fx.links(spark, d).where("link_type = 'contains'").unionByName(uses))


@query(W + """SELECT DISTINCT n.node_key AS symbol, concat('part/', l_partkey) AS file FROM nodes n JOIN lineitem ON concat('order', l_orderkey) = n.name WHERE n.kind='symbol' AND n.node_key NOT IN (SELECT dst FROM links WHERE link_type NOT IN ('contains','lexical_parent','lexical_owner')) AND concat('part/', l_partkey) <> n.path""")
def impact_fallback(spark, d):
    sites = table(spark, d, "lineitem").select(F.concat(F.lit("part/"), "l_partkey").alias("file_path"), F.concat(F.lit("order"), "l_orderkey").alias("target_function"))
    return impact.fallback_files(fx.nodes(spark, d), fx.links(spark, d), sites)


@query(W + """, c AS (SELECT concat('customer/', c_custkey) AS k FROM customer WHERE c_nationkey = 1)
SELECT k AS start, k AS node, 0 AS hops FROM c UNION ALL SELECT DISTINCT l.src, l.dst, 1 FROM links l JOIN c ON c.k=l.src
UNION ALL SELECT DISTINCT l.src, m.dst, 2 FROM links l JOIN c ON c.k=l.src JOIN links m ON m.src=l.dst
UNION ALL SELECT DISTINCT l.src, o.dst, 3 FROM links l JOIN c ON c.k=l.src JOIN links m ON m.src=l.dst JOIN links o ON o.src=m.dst""")
def impact_closure(spark, d):
    start = table(spark, d, "customer").where("c_nationkey = 1").select(F.concat(F.lit("customer/"), "c_custkey").alias("node_key"))
    return impact.closure(fx.links(spark, d), start)


@query(W + """, c AS (SELECT node_key AS k FROM nodes), r AS (SELECT k AS start, k AS node, 0 AS hops FROM c UNION ALL SELECT src, dst, 1 FROM links
UNION ALL SELECT DISTINCT l.src, m.dst, 2 FROM links l JOIN links m ON m.src=l.dst
UNION ALL SELECT DISTINCT l.src, o.dst, 3 FROM links l JOIN links m ON m.src=l.dst JOIN links o ON o.src=m.dst)
SELECT start, node, min(hops) AS hops FROM r GROUP BY 1,2""")
def impact_closure_all(spark, d):
    return impact.closure(fx.links(spark, d), fx.nodes(spark, d))


@query(W + ", p AS (SELECT x.k, count(DISTINCT l.src) AS n FROM (SELECT DISTINCT concat('part/', l_partkey) AS k FROM lineitem WHERE l_returnflag='R') x LEFT JOIN links l ON l.dst=x.k GROUP BY 1), s AS (SELECT count(*) AS changed_files, coalesce(sum(n),0)::BIGINT AS impacted FROM p), v AS (SELECT *, " + _RISK.format(c="impacted", t="(SELECT count(*) FROM nodes)") + " AS r FROM s) SELECT changed_files, impacted, CASE WHEN r='LOW' AND changed_files > 10 THEN 'MEDIUM' ELSE r END AS risk FROM v")
def impact_review(spark, d):
    changes = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("part/"), "l_partkey").alias("path"))
    return impact.review(changes, impact.blast_radius(fx.links(spark, d)), fx.nodes(spark, d))


@query(W + """, r AS (SELECT DISTINCT dst AS target, src AS dependent FROM links), b AS (SELECT target, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, target LIMIT 5),
x AS (SELECT b.target, b.n, nodes.name, row_number() OVER (PARTITION BY b.target ORDER BY nodes.name, r.dependent) AS i FROM b JOIN r ON r.target=b.target JOIN nodes ON node_key=r.dependent)
SELECT target, n, list(name ORDER BY i) AS top_names FROM x WHERE i <= 5 GROUP BY 1,2""")
def impact_top_by_file(spark, d):
    return impact.top_by_file(impact.blast_radius(fx.links(spark, d)), fx.nodes(spark, d))


@query("""SELECT p_partkey, CASE WHEN p_size=50 THEN 'stale' WHEN p_partkey%7=0 THEN 'unknown' WHEN p_size<10 THEN 'partial' WHEN p_size%5=0 THEN 'dynamic' ELSE 'exact' END AS level,
CASE WHEN p_size<>50 AND p_partkey%7=0 THEN CASE WHEN p_size<10 THEN 'coverage' WHEN p_size%3=0 THEN 'registry' WHEN p_size%4=0 THEN 'call-site-gap' WHEN p_size%5=0 THEN 'dynamic' WHEN p_size>40 THEN 'low-resolution' ELSE 'static-only' END END AS note FROM part""")
def impact_epistemic(spark, d):
    s = F.col("p_size")
    states = table(spark, d, "part").select(
        "p_partkey", (s == 50).alias("stale"), (F.col("p_partkey") % 7).alias("dependents"), F.when(s < 10, 0.5).otherwise(1.0).alias("coverage"), (s % 3 != 0).alias("registry_ok"),
        F.when(s % 4 == 0, 1).otherwise(0).alias("call_site_gap"), F.when(s % 5 == 0, 1).otherwise(0).alias("dynamic"), F.when(s > 40, 0.4).otherwise(0.9).alias("resolution_rate"),
    )
    return impact.epistemic(states).select("p_partkey", "level", "note")
