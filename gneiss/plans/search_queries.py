"""Queries of keyword search, text functions and discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import text
from gneiss.operators import discovery, search
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


_STOP = "'a','an','and','are','can','do','does','for','from','how','i','in','is','it','me','of','on','or','show','that','the','this','to','what','when','where','which','who','why','with'"


@query(f"SELECT item_id, list_distinct_ordered AS keywords FROM (SELECT item_id, list_filter(list_filter(string_split_regex(text, '[^A-Za-z0-9_./-]+'), lambda x: x <> '' AND lower(x) NOT IN ({_STOP})), lambda x, i: list_position(list_filter(string_split_regex(text, '[^A-Za-z0-9_./-]+'), lambda y: y <> '' AND lower(y) NOT IN ({_STOP})), x) = i) AS list_distinct_ordered FROM eval_items)")
def search_keywords(spark, d):
    return table(spark, d, "eval_items").select("item_id", text.keywords(F.col("text")).alias("keywords"))


def _wanted(spark, d):
    """Queries from the titles of decisions' types: one query a part type, of its words."""
    p = table(spark, d, "part").select(F.col("p_type").alias("query")).distinct()
    return p.select("query", text.keywords(F.col("query")).alias("keywords"))


def _index(spark, d):
    return search.inverted_index(fx.nodes(spark, d), "node_key", ["name", "description", "path"])


@query()
def search_bm25(spark, d):
    return search.top_k(search.bm25(_index(spark, d), search.phrases(_wanted(spark, d))), 10).select("query", "key", F.round("score", 6).alias("score"), "matched", "rank")


@query("WITH " + fx.SQL + """, q AS (SELECT DISTINCT p_type AS query FROM part) SELECT q.query, n.node_key AS key FROM q JOIN nodes n ON n.description = q.query""")
def search_membership(spark, d):
    hits = search.bm25(search.inverted_index(fx.nodes(spark, d).where("kind = 'file' AND node_key LIKE 'part/%'"), "node_key", ["description"]), search.phrases(_wanted(spark, d)))
    return hits.select("query", "key")


@query()
def search_hybrid(spark, d):
    best = search.top_k(search.bm25(_index(spark, d), search.phrases(_wanted(spark, d))), 10)
    keyword = best.select("query", F.lit("l2").alias("layer"), F.col("key").alias("id"), F.lit("keyword").alias("match"), search.rank_score(0.9, F.col("rank") - 1).alias("score"), F.col("rank").alias("seq"))
    exact = fx.nodes(spark, d).join(_wanted(spark, d), F.col("description") == F.col("query")).groupBy("query").agg(F.min("node_key").alias("id")).select(
        "query", F.lit("l2").alias("layer"), "id", F.lit("exact").alias("match"), F.lit(0.95).alias("score"), F.lit(1000).alias("seq")
    )
    return search.hybrid(keyword.unionByName(exact), 10)


@query("""SELECT doc_id, sha256(coalesce(doc_kind,'')||chr(10)||coalesce(source,'')||chr(10)||coalesce(text,'')) AS hash FROM documents""")
def text_decision_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", text.decision_hash(F.col("doc_kind"), F.col("source"), F.col("text")).alias("hash"))


@query("SELECT o_orderkey, 'call-site:v1:'||sha256(o_orderkey::VARCHAR||chr(0)||o_custkey::VARCHAR||chr(0)||o_orderpriority) AS key, ('0x'||substr(sha256(o_orderkey::VARCHAR),1,8))::BIGINT/4294967296.0::DOUBLE AS bucket FROM orders")
def text_site_keys(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", text.call_site_key(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")).alias("key"), text.canary_bucket(F.col("o_orderkey").cast("string")).alias("bucket")
    )


@query(r"""SELECT decision_id, lower(trim(regexp_replace(title,'\s+',' ','g'))) AS title, trim(regexp_replace(content,'\s+',' ','g')) AS content FROM decisions""")
def text_normalised(spark, d):
    return table(spark, d, "decisions").select("decision_id", text.normalised_title(F.col("title")).alias("title"), text.normalised_content(F.col("content")).alias("content"))


@query(r"""WITH s AS (SELECT doc_id, trim(string_split(text, chr(10))[1], chr(32)||chr(9)||chr(13)||chr(11)||chr(12)) AS t FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, t, lower(regexp_extract(t,'^([A-Za-z]+)(\([^)]*\))?!?:',1)) AS y FROM s)
SELECT doc_id, nullif(y,'') AS type, (length(regexp_replace(t,'^[A-Za-z]+(\([^)]*\))?!?:\s*',''))>=10 AND NOT regexp_matches(t,'^(wip|fixup!|squash!|typo|lint|format|merge branch)','i') AND y NOT IN ('chore','style','ci','build','docs','test')) AS keep FROM y""")
def text_commit_filter(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.commit_type(F.col("text")).alias("type"), text.worth_reading(F.col("text")).alias("keep"))


@query("""WITH f AS (SELECT change_id, string_split(trim(file_path),'/') AS p FROM file_changes) SELECT change_id, CASE WHEN len(p)<=1 OR p[1] LIKE '.%' OR p[1] IN ('node_modules','dist','build','docs','test','tests','scripts') THEN NULL ELSE (SELECT CASE WHEN x LIKE '%.%' OR x IN ('src','lib','app') THEN NULL ELSE x END FROM (SELECT CASE WHEN p[1]='src' THEN p[2] WHEN len(p)>3 AND p[1] IN ('packages','artifacts','crates') AND p[3]='src' THEN p[2] ELSE p[1] END AS x)) END AS domain FROM f""")
def text_domain(spark, d):
    return table(spark, d, "file_changes").select("change_id", text.domain(F.col("file_path")).alias("domain"))


@query("""SELECT doc_id, replace(replace(replace(replace(text,'&','&amp;'),'<','&lt;'),'>','&gt;'),'"','&quot;') AS escaped, CASE WHEN length(text)>80 THEN substr(text,1,77)||'...' ELSE text END AS short, ceil(length(coalesce(text,''))/4)::BIGINT AS tokens FROM documents""")
def text_escape(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.xml_escape(t).alias("escaped"), text.ellipsis(t, 80).alias("short"), text.token_estimate(t).alias("tokens"))


@query()
def text_stems(spark, d):
    words = table(spark, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", text.porter("word").alias("stem"))


@query()
def discovery_funnel(spark, d):
    p = table(spark, d, "parse_requests")
    return p.select("task_id", discovery.funnel_reason(F.col("file_path"), F.col("code"), F.col("n_bytes"), 8000).alias("reason")).distinct()


@query()
def discovery_dynamic_imports(spark, d):
    p = table(spark, d, "parse_requests").select(F.col("file_path").alias("path"), F.col("code").alias("text"))
    return discovery.dynamic_imports(p).groupBy("specifier", "literal").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey AS request_id, (SELECT s.c_name FROM (SELECT c_name, CASE WHEN c_name='Customer#'||lpad(p_partkey::VARCHAR,9,'0') THEN 0 WHEN c_name='Customer#'||lpad(p_partkey::VARCHAR,9,'0')||'.x' THEN 1 END AS i FROM customer) s WHERE i IS NOT NULL ORDER BY i LIMIT 1) AS path FROM part""")
def discovery_first_existing(spark, d):
    r = table(spark, d, "part").select(F.col("p_partkey").alias("request_id"), F.concat(F.lit("Customer#"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("stem"))
    return discovery.first_existing(r, table(spark, d, "customer").select(F.col("c_name").alias("path")), ["", ".x"])


@query("""WITH a AS (SELECT l_returnflag AS t, l_partkey AS n, min_by(l_quantity::VARCHAR, l_orderkey*10+l_linenumber) AS s FROM lineitem WHERE l_linestatus='O' GROUP BY 1,2), b AS (SELECT l_returnflag AS t, l_partkey AS n, min_by(l_quantity::VARCHAR, l_orderkey*10+l_linenumber) AS s FROM lineitem WHERE l_linestatus='F' GROUP BY 1,2)
SELECT coalesce(a.t,b.t) AS type, coalesce(a.n,b.n) AS name, CASE WHEN a.s=b.s THEN 'internal' ELSE 'contract' END AS change FROM a FULL JOIN b ON a.t=b.t AND a.n=b.n""")
def discovery_signature_changes(spark, d):
    li = table(spark, d, "lineitem")
    side = lambda s: li.where(F.col("l_linestatus") == s).select(F.col("l_returnflag").alias("type"), F.col("l_partkey").alias("name"), F.col("l_quantity").cast("string").alias("signature"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return discovery.signature_changes(side("O"), side("F"))


@query("""WITH r AS (SELECT c_mktsegment AS project, c_nationkey AS n FROM customer), u AS (SELECT 0 AS id, '1' AS nm, 'a' AS tag, 'lib' AS ty UNION ALL SELECT 1,'2','b','app' UNION ALL SELECT 2,'99','c','svc'),
p AS (SELECT project, list_sort(list(DISTINCT tag)) AS tags, max_by(ty, id) AS t FROM r JOIN u ON n::VARCHAR=nm GROUP BY 1)
SELECT DISTINCT r.project, coalesce(p.tags,['general']) AS tags, coalesce(p.t,'generic') AS project_type FROM r LEFT JOIN p USING (project)""")
def discovery_config_rules(spark, d):
    files = table(spark, d, "customer").select(F.col("c_mktsegment").alias("project"), F.col("c_nationkey").cast("string").alias("name"), F.col("c_name").alias("content"))
    rules = spark.createDataFrame([(0, "1", None, "a", "lib"), (1, "2", None, "b", "app"), (2, "99", None, "c", "svc")], "rule_id int, name string, marker string, tag string, type string")
    return discovery.config_rules(files, rules)
