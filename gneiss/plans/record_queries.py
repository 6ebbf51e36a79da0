"""Queries of resolution records, lookups, contexts and the whole blast radius.

The projections of the test tables (plain SQL expressions that both engines read) are shared with the oracle, the operators are not.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import context as cx
from gneiss.operators import records as rc
from gneiss.sources import fixtures as fx
from gneiss.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_HEADS = [
    "l_linenumber % 2 AS project_id", "concat('s', l_orderkey * 10 + l_linenumber) AS site_key", "concat('f', l_suppkey) AS file_path", "l_orderkey % 400 AS line", "l_linenumber AS col",
    "concat('h', l_partkey % 3) AS source_hash", "CASE WHEN l_quantity < 10 THEN 'proven' WHEN l_quantity < 25 THEN 'likely' WHEN l_quantity < 40 THEN 'ambiguous' ELSE 'odd' END AS cls",
    "CASE WHEN l_quantity < 20 THEN concat('t', l_partkey) END AS selected", "CASE WHEN l_quantity > 8 THEN l_discount * 12 END AS confidence", "l_tax > 0.07 AS stale",
    "CASE WHEN l_partkey % 9 = 0 THEN ' ' ELSE concat(l_returnflag, l_suppkey % 7) END AS signature", "CASE WHEN l_linenumber = 1 THEN 'verified' WHEN l_linenumber = 2 THEN 'contradicted' ELSE 'none' END AS verification",
    "CASE WHEN l_linenumber < 2 THEN concat('t', l_partkey) END AS verified", "l_orderkey AS idx",
]
_CANDS = ["l_linenumber % 2 AS project_id", "concat('s', l_orderkey * 10 + l_linenumber % 4) AS site_key", "l_linenumber AS ordinal", "concat('t', l_partkey % 50) AS target"]
_DEPS = ["l_linenumber % 2 AS project_id", "concat('s', l_orderkey * 10 + l_linenumber) AS site_key", "concat('f', l_partkey % 5 + l_suppkey) AS path", "concat('h', l_partkey % 2) AS hash"]
_SITES = ["l_linenumber % 2 AS project_id", "concat('f', l_suppkey) AS file_path", "l_orderkey % 400 AS line", "l_linenumber AS col", "concat('h', l_partkey % 4) AS source_hash"]
_W = "WITH heads AS (SELECT " + ", ".join(_HEADS) + " FROM lineitem), cands AS (SELECT " + ", ".join(_CANDS) + " FROM lineitem), deps AS (SELECT " + ", ".join(_DEPS) + " FROM lineitem), live AS (SELECT " + ", ".join(_SITES) + " FROM lineitem WHERE l_quantity > 5)"


def _of(spark, d, exprs, name="lineitem", where="true"):
    return table(spark, d, name).where(where).selectExpr(*exprs)


@query(_W + " SELECT site_key, file_path FROM heads WHERE file_path IN (SELECT concat('f', s_suppkey) FROM supplier WHERE s_nationkey < 5)")
def records_lookup(spark, d):
    wanted = table(spark, d, "supplier").where("s_nationkey < 5").select(F.concat(F.lit("f"), "s_suppkey").alias("w"))
    return rc.lookup(_of(spark, d, _HEADS), "file_path", wanted).select("site_key", "file_path")


@query(_W + ", w AS (SELECT concat('t', p_partkey) AS w FROM part WHERE p_size = 7 UNION SELECT 'R3') SELECT DISTINCT site_key, selected, signature FROM heads WHERE selected IN (FROM w) OR signature IN (FROM w)")
def records_lookup_any(spark, d):
    wanted = table(spark, d, "part").where("p_size = 7").select(F.concat(F.lit("t"), "p_partkey").alias("w")).union(spark.createDataFrame([("R3",)], "w string"))
    return rc.lookup_any(_of(spark, d, _HEADS).select("site_key", "selected", "signature"), ["selected", "signature"], wanted)


_NODES = ["concat('n', p_partkey) AS node_key", "CASE WHEN p_size = 50 THEN '[broken' WHEN p_size = 49 THEN NULL WHEN p_size = 48 THEN '[]' ELSE concat('[\"', p_brand, '\",\"', p_type, '\"]') END AS patterns"]
_N = "WITH n AS (SELECT concat('n', p_partkey) AS node_key, p_brand, p_type, p_size FROM part), act AS (SELECT DISTINCT p_brand AS path FROM part WHERE p_brand LIKE '%2' UNION SELECT 'PROMO')"


def _active(spark, d):
    return table(spark, d, "part").where("p_brand LIKE '%2'").select(F.col("p_brand").alias("path")).union(spark.createDataFrame([("PROMO",)], "path string")).distinct()


@query(_N + " SELECT node_key FROM n WHERE p_size < 48 AND (p_brand IN (FROM act) OR p_type IN (FROM act))")
def records_changed_nodes(spark, d):
    return rc.nodes_for_files(_of(spark, d, _NODES, "part"), _active(spark, d))


@query(_N + " SELECT node_key FROM n WHERE NOT (p_size < 48 AND (p_brand IN (FROM act) OR p_type IN (FROM act)))")
def records_stale_nodes(spark, d):
    return rc.stale_nodes(_of(spark, d, _NODES, "part"), _active(spark, d))


@query(_N + " SELECT node_key, CASE WHEN p_size < 48 THEN p_brand END AS first FROM n")
def records_first_pattern(spark, d):
    return _of(spark, d, _NODES, "part").select("node_key", rc.first_pattern(F.col("patterns")).alias("first"))


@query(_N + """, kept AS (SELECT node_key FROM n WHERE p_size < 48 AND (p_brand IN (FROM act) OR p_type IN (FROM act))), l AS (SELECT concat('n', l_partkey) AS src, concat('n', l_suppkey) AS dst FROM lineitem)
SELECT (SELECT count(DISTINCT p_brand) FROM part WHERE p_brand NOT IN (FROM act)) AS pruned_files, (SELECT count(*) FROM n WHERE node_key NOT IN (FROM kept)) AS pruned_nodes, (SELECT count(*) FROM l WHERE src IN (FROM kept) AND dst IN (FROM kept)) AS kept_links""")
def records_prune(spark, d):
    files = table(spark, d, "part").select(F.col("p_brand").alias("path")).distinct()
    links = table(spark, d, "lineitem").select(F.concat(F.lit("n"), "l_partkey").alias("src"), F.concat(F.lit("n"), "l_suppkey").alias("dst"))
    _, _, kept, counts = rc.prune(files, _of(spark, d, _NODES, "part"), links, _active(spark, d))
    return counts.crossJoin(kept.agg(F.count(F.lit(1)).alias("kept_links")))


@query(_W + """, c AS (SELECT project_id, site_key, list(target ORDER BY ordinal, target) AS candidates FROM cands GROUP BY 1, 2), p AS (SELECT project_id, site_key, list(path ORDER BY path, hash) AS paths FROM (SELECT DISTINCT * FROM deps) GROUP BY 1, 2)
SELECT h.project_id, h.site_key, coalesce(candidates, []) AS candidates, coalesce(paths, []) AS paths FROM heads h LEFT JOIN c USING (project_id, site_key) LEFT JOIN p USING (project_id, site_key)""")
def records_read(spark, d):
    out = rc.read_records(_of(spark, d, _HEADS), _of(spark, d, _CANDS), _of(spark, d, _DEPS))
    return out.select("project_id", "site_key", "candidates", F.transform("dependencies", lambda x: x["path"]).alias("paths"))


@query(_W + ", f AS (SELECT DISTINCT project_id, file_path FROM heads WHERE line < 20), r AS (SELECT project_id, file_path, concat('new', site_key) AS site_key FROM heads WHERE line < 30) SELECT project_id, file_path, site_key FROM heads WHERE (project_id, file_path) NOT IN (FROM f) UNION ALL SELECT * FROM r WHERE (project_id, file_path) IN (FROM f)")
def records_replace(spark, d):
    h = _of(spark, d, _HEADS).select("project_id", "file_path", "site_key", "line")
    new = h.where("line < 30").select("project_id", "file_path", F.concat(F.lit("new"), "site_key").alias("site_key"))
    return rc.replace_for_files(h.drop("line"), new, h.where("line < 20"))


@query(_W + """, e AS (SELECT project_id, site_key, file_path AS path, source_hash AS hash FROM heads UNION ALL SELECT * FROM deps)
SELECT project_id, site_key, path, CASE WHEN min(hash) = max(hash) THEN min(hash) END AS hash, min(hash) <> max(hash) AS conflict FROM e GROUP BY 1, 2, 3""")
def records_dependencies(spark, d):
    return rc.normal_dependencies(_of(spark, d, _HEADS), _of(spark, d, _DEPS))


@query(_W + """, c AS (SELECT project_id, site_key, count(*) <> count(DISTINCT ordinal) OR count(*) <> count(DISTINCT target) AS bad FROM cands GROUP BY 1, 2),
t AS (SELECT project_id, site_key, count(*) > 1 AS twice FROM heads GROUP BY 1, 2),
r AS (SELECT DISTINCT project_id, site_key, CASE WHEN twice THEN 'duplicate-key' WHEN coalesce(bad, false) THEN 'duplicate-candidate' WHEN cls = 'odd' THEN 'unknown-class'
 WHEN selected IS NOT NULL AND cls NOT IN ('proven', 'likely') AND NOT (verification = 'verified' AND verified = selected) OR selected IS NULL AND cls IN ('proven', 'likely') THEN 'selection'
 WHEN confidence IS NOT NULL AND (confidence NOT BETWEEN 0 AND 1 OR cls <> 'likely') THEN 'confidence' WHEN (verification IN ('verified', 'contradicted')) <> (verified IS NOT NULL) THEN 'verification' END AS reason FROM heads JOIN t USING (project_id, site_key) LEFT JOIN c USING (project_id, site_key))
SELECT * FROM r WHERE reason IS NOT NULL""")
def records_violations(spark, d):
    return rc.violations(_of(spark, d, _HEADS), _of(spark, d, _CANDS))


@query(_W + """, h AS (SELECT *, count(*) OVER (PARTITION BY project_id, file_path, line, col) AS n FROM heads), s AS (SELECT project_id, file_path, line, col, min(source_hash) AS live FROM live GROUP BY 1, 2, 3, 4 HAVING count(*) = 1)
SELECT site_key FROM h JOIN s USING (project_id, file_path, line, col) WHERE n = 1 AND source_hash = live AND NOT stale AND trim(signature) <> ''""")
def records_current(spark, d):
    return rc.current_resolutions(_of(spark, d, _HEADS), _of(spark, d, _SITES, where="l_quantity > 5")).select("site_key")


@query(_W + """, h AS (SELECT project_id, file_path, line, col, count(*) AS h FROM heads GROUP BY ALL), s AS (SELECT project_id, file_path, line, col, count(*) AS s FROM live GROUP BY ALL)
SELECT project_id, file_path, bool_and(coalesce(h, 0) = 1 AND coalesce(s, 0) = 1) AS complete FROM h FULL JOIN s USING (project_id, file_path, line, col) GROUP BY 1, 2""")
def records_covered(spark, d):
    return rc.covered_files(_of(spark, d, _HEADS), _of(spark, d, _SITES, where="l_quantity > 5"))


@query(_W + """, x AS (SELECT site_key, idx, cls, signature, signature LIKE 'N%' AS c, signature LIKE '%6' AS q, (line % 10) / 10.0 AS b FROM heads)
SELECT site_key, CASE WHEN q THEN 'ambiguous' ELSE cls END AS cls, CASE WHEN c AND cls = 'proven' AND NOT q THEN 'canary' ELSE 'verify' END AS mode, idx FROM x WHERE NOT (c AND cls = 'proven' AND NOT q) OR b < 0.25""")
def records_forward(spark, d):
    h = _of(spark, d, _HEADS)
    signatures = h.select("signature").distinct()
    return rc.forward_requests(h, signatures.where("signature LIKE 'N%'"), signatures.where("signature LIKE '%6'"), (F.col("line") % 10) / 10.0, 0.25)


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1")
def records_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return rc.latest_by(e, ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("""WITH a AS (SELECT p_brand AS signature, min(p_size) AS since, min(p_type) AS old FROM part WHERE p_brand LIKE '%1' GROUP BY 1), u AS (SELECT DISTINCT p_brand AS signature FROM part WHERE p_brand LIKE '%2'), r AS (SELECT p_brand AS signature, p_partkey % 60 AS evidence_at, p_type AS config_hash FROM part)
SELECT r.signature, CASE WHEN since IS NULL THEN CASE WHEN u.signature IS NULL THEN 'not-found' ELSE 'already-cleared' END WHEN old = config_hash OR evidence_at <= since THEN 'rejected' ELSE 'cleared' END AS outcome FROM r LEFT JOIN a USING (signature) LEFT JOIN u USING (signature)""")
def records_clear_quarantine(spark, d):
    p = table(spark, d, "part")
    active = p.where("p_brand LIKE '%1'").groupBy(F.col("p_brand").alias("signature")).agg(F.min("p_size").alias("since"), F.min("p_type").alias("config_hash"))
    audits = p.where("p_brand LIKE '%2'").select(F.col("p_brand").alias("signature"), F.col("p_partkey").alias("id"))
    return rc.clear_quarantine(active, audits, p.select(F.col("p_brand").alias("signature"), F.col("p_type").alias("config_hash"), (F.col("p_partkey") % 60).alias("evidence_at")))


@query("""SELECT p_brand AS path, count(*) AS n FROM part WHERE p_brand NOT LIKE '%3' AND p_brand NOT LIKE '%4' GROUP BY 1 UNION ALL SELECT p_brand, -count(*) FROM part WHERE p_brand LIKE '%3' GROUP BY 1""")
def records_stats_merge(spark, d):
    n = table(spark, d, "part").groupBy(F.col("p_brand").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return rc.stats_merge(n, n.where("path LIKE '%3'").select("path", (-F.col("n")).alias("n")), n.where("path LIKE '%4'"))


@query("""WITH k AS (SELECT DISTINCT target_key AS k FROM graph_edges WHERE target_key IS NOT NULL), f AS (SELECT DISTINCT source_key AS f FROM graph_edges WHERE source_key IS NOT NULL) SELECT DISTINCT k AS node_key FROM k JOIN f ON k.k = f.f UNION SELECT DISTINCT k FROM k JOIN f ON substr(k.k, 1, length(f.f) + 1) = f.f || '#' AND string_split(k.k, '#')[1] = string_split(f.f, '#')[1]""")
def records_key_in_files(spark, d):
    e = table(spark, d, "graph_edges")
    keys = e.select(F.col("target_key").alias("node_key")).dropna().distinct()
    return rc.key_in_files(keys, e.select(F.col("source_key").alias("path")).dropna())


_SPAN = ["o_custkey AS path", "concat('o', o_orderkey) AS symbol", "o_orderkey % 97 AS start_line", "o_orderkey % 97 + 1 + o_orderkey % 13 AS end_line"]


@query("WITH s AS (SELECT " + ", ".join(_SPAN) + """ FROM orders), j AS (SELECT a.path, a.symbol, b.symbol AS o, row_number() OVER (PARTITION BY a.path, a.symbol ORDER BY b.end_line - b.start_line, b.symbol) AS i
 FROM s a JOIN s b ON a.path = b.path AND b.start_line <= a.start_line AND b.end_line >= a.end_line AND b.end_line - b.start_line > a.end_line - a.start_line) SELECT s.path, s.symbol, o AS parent FROM s LEFT JOIN j ON j.path = s.path AND j.symbol = s.symbol AND i = 1""")
def records_lexical_parents(spark, d):
    return rc.lexical_parents(_of(spark, d, _SPAN, "orders"))


_LINKS = """l2 AS (SELECT DISTINCT concat('customer/', o_custkey) AS src, concat('customer/', o_custkey, '#order', o_orderkey) AS dst, 'contains' AS t FROM orders
 UNION SELECT concat('part/', l_partkey), concat('customer/', o_custkey, '#order', o_orderkey), 'calls' FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 40
 UNION SELECT concat('supplier/', l_suppkey), concat('customer/', o_custkey), 'depends_on' FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 48)"""


def _links(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    file, symbol = F.concat(F.lit("customer/"), "o_custkey"), F.concat(F.lit("customer/"), "o_custkey", F.lit("#order"), "o_orderkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    tag = lambda df, t: df.toDF("src", "dst").withColumn("link_type", F.lit(t))
    out = tag(o.select(file, symbol), "contains").unionByName(tag(j.where("l_quantity > 40").select(F.concat(F.lit("part/"), "l_partkey"), symbol), "calls"))
    return out.unionByName(tag(j.where("l_quantity > 48").select(F.concat(F.lit("supplier/"), "l_suppkey"), file), "depends_on")).distinct()


@query("WITH " + fx.SQL + ", " + _LINKS + """, direct AS (SELECT DISTINCT l.dst AS target, l.src AS other, n.name FROM l2 l JOIN nodes n ON n.node_key = l.src),
rollup0 AS (SELECT DISTINCT c.src AS target, u.src AS other, n.name FROM l2 c JOIN l2 u ON u.dst = c.dst AND u.t <> 'contains' JOIN nodes n ON n.node_key = u.src WHERE c.t = 'contains' AND u.src <> c.src),
rolled AS (SELECT * FROM rollup0 r WHERE NOT EXISTS (SELECT 1 FROM direct x WHERE x.target = r.target AND x.other = r.other)),
shown AS (SELECT target, name FROM direct UNION SELECT target, name FROM rolled),
fb AS (SELECT DISTINCT n.node_key AS target, p.p_name AS name FROM nodes n JOIN lineitem ON concat('order', l_orderkey) = n.name JOIN part p ON p.p_partkey = l_partkey WHERE n.kind = 'symbol' AND l_linenumber < 3 AND n.node_key NOT IN (SELECT dst FROM l2 WHERE t <> 'contains')),
fb2 AS (SELECT * FROM fb WHERE (target, name) NOT IN (SELECT target, name FROM shown)), shown2 AS (FROM shown UNION FROM fb2),
con AS (SELECT DISTINCT c.dst AS target, n.name FROM l2 c JOIN l2 u ON u.dst = c.src AND u.t <> 'contains' JOIN nodes n ON n.node_key = u.src WHERE c.t = 'contains')
SELECT target, name, 'direct' AS layer FROM direct UNION ALL SELECT target, name, 'rollup' FROM rolled UNION ALL SELECT target, name, 'fallback' FROM fb2 UNION ALL SELECT target, name, 'container' FROM con WHERE (target, name) NOT IN (SELECT target, name FROM shown2)""")
def impact_layers(spark, d):
    nodes = fx.nodes(spark, d)
    sites = table(spark, d, "lineitem").where("l_linenumber < 3").select(F.concat(F.lit("part/"), "l_partkey").alias("file_path"), F.concat(F.lit("order"), "l_orderkey").alias("target_function"))
    return cx.blast_radius_layers(nodes, _links(spark, d), nodes.select("node_key"), sites)


@query("WITH " + fx.SQL + ", " + _LINKS + """, k AS (SELECT DISTINCT * FROM l2 WHERE t <> 'contains'), r AS (SELECT DISTINCT src, dst, CASE WHEN length(src) % 2 = 0 THEN ['static-proof'] ELSE ['static-proof', 'tier-b-verified'] END AS labels FROM k WHERE length(dst) % 3 = 0)
SELECT k.dst AS target, 'incoming' AS direction, n.name, k.t AS link_type, CASE WHEN k.t = 'calls' THEN coalesce(labels, []) END AS summaries FROM k JOIN nodes n ON n.node_key = k.src LEFT JOIN r ON r.src = k.src AND r.dst = k.dst
UNION ALL SELECT k.src, 'outgoing', n.name, k.t, CASE WHEN k.t = 'calls' THEN coalesce(labels, []) END FROM k JOIN nodes n ON n.node_key = k.dst LEFT JOIN r ON r.src = k.src AND r.dst = k.dst""")
def context_relations(spark, d):
    nodes, links = fx.nodes(spark, d), _links(spark, d)
    labels = F.when(F.length("src") % 2 == 0, F.array(F.lit("static-proof"))).otherwise(F.array(F.lit("tier-b-verified"), F.lit("static-proof")))
    res = links.where("link_type <> 'contains' AND length(dst) % 3 = 0").select(F.col("src").alias("caller"), F.col("dst").alias("callee"), F.explode(labels).alias("label"))
    return cx.relations(nodes, links, nodes.select("node_key"), res)


@query("WITH " + fx.SQL + ", " + _LINKS + """, f AS (SELECT node_key AS path, CASE WHEN length(node_key) % 2 = 0 THEN length(node_key) END AS done FROM nodes WHERE kind = 'file'), t AS (SELECT count(done) AS p, count(*) AS n FROM f), k AS (SELECT * FROM l2 WHERE t <> 'contains')
SELECT nodes.node_key AS target, f.done AS processed_at, t.p AS files_processed, t.n AS files_total FROM nodes LEFT JOIN f ON f.path = nodes.path, t WHERE (nodes.node_key NOT IN (SELECT src FROM k) AND f.done IS NULL) OR (nodes.node_key NOT IN (SELECT dst FROM k) AND t.p < t.n)""")
def context_hints(spark, d):
    nodes = fx.nodes(spark, d)
    n = F.length("node_key")
    files = nodes.where("kind = 'file'").select(F.col("node_key").alias("path"), F.when(n % 2 == 0, n).alias("processed_at"))
    return cx.coverage_hints(nodes, _links(spark, d), nodes.select("node_key"), files)


@query("WITH " + fx.SQL + ", " + _LINKS + """, b AS (SELECT src AS target, dst AS other, 0 AS d FROM l2 UNION SELECT dst, src, 1 FROM l2), r AS (SELECT b.target, b.other, n.name, row_number() OVER (PARTITION BY target ORDER BY d, other) - 1 AS i FROM b JOIN nodes n ON n.node_key = b.other) SELECT * FROM r WHERE i < 10""")
def context_neighbours(spark, d):
    nodes = fx.nodes(spark, d)
    return cx.neighbour_slice(nodes, _links(spark, d), nodes.select("node_key"), -1)


@query("""WITH k AS (SELECT p_brand AS query, CASE WHEN p_partkey % 2 = 0 THEN 'l2' ELSE 'l3' END AS layer, p_size AS id, row_number() OVER (PARTITION BY p_brand, p_partkey % 2 ORDER BY p_partkey) - 1 AS i FROM part),
e AS (SELECT query, layer, id, CASE WHEN layer = 'l2' THEN 0.9 ELSE 0.85 END - 0.01 * i AS score, 'keyword' AS match, CASE WHEN layer = 'l2' THEN 0 ELSE 1 END AS part, i FROM k WHERE i < 10 UNION ALL SELECT p_brand, 'l2', min(p_size), 0.95, 'exact', 2, 0 FROM part GROUP BY p_brand
 UNION ALL SELECT query, 'l2', id, 0.7 - 0.01 * i, 'neighbor', 3, i FROM k WHERE layer = 'l3' AND i < 10),
s AS (SELECT *, min(part * 1000 + i) OVER (PARTITION BY query, layer, id) AS first, row_number() OVER (PARTITION BY query, layer, id ORDER BY round(score, 9) DESC, part, i) AS r FROM e), p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, first) AS position FROM s WHERE r = 1)
SELECT query, layer, id, round(score, 6)::DOUBLE AS score, match, position FROM p WHERE position <= 10""")
def context_search(spark, d):
    p = table(spark, d, "part")
    k = p.selectExpr("p_brand AS query", "CASE WHEN p_partkey % 2 = 0 THEN 'l2' ELSE 'l3' END AS layer", "p_size AS id", "row_number() OVER (PARTITION BY p_brand, p_partkey % 2 ORDER BY p_partkey) - 1 AS i").where("i < 10")
    exact = p.groupBy(F.col("p_brand").alias("query")).agg(F.min("p_size").alias("id"))
    return cx.merged_search(k, exact, k.where("layer = 'l3'").select("query", "id", "i"), 10)


@query("WITH w AS (SELECT DISTINCT l2_node_key AS node_key, title, validity_status FROM decisions WHERE l2_node_key IS NOT NULL) SELECT node_key, list(coalesce(title, '') || '|' || coalesce(validity_status, '') ORDER BY coalesce(title, '') || '|' || coalesce(validity_status, '')) AS why FROM (SELECT DISTINCT node_key, coalesce(title, '') AS title, coalesce(validity_status, '') AS validity_status FROM w) GROUP BY 1")
def context_why(spark, d):
    dec = table(spark, d, "decisions").where("l2_node_key IS NOT NULL").withColumnRenamed("l2_node_key", "node_key")
    text = F.concat_ws("|", F.coalesce("title", F.lit("")), F.coalesce("validity_status", F.lit("")))
    return cx.why(dec.select("node_key"), dec, [text.alias("t")]).select("node_key", F.transform("why", lambda x: x["t"]).alias("why"))
