"""Queries of call resolution and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import text
from gneiss.operators import maintenance as mt
from gneiss.operators import resolution as rs
from gneiss.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_SITES = """sites AS (SELECT l_orderkey*10+l_linenumber AS site_id, l_partkey AS caller, l_suppkey AS target, CASE WHEN l_quantity<10 THEN 'proven' WHEN l_quantity<25 THEN 'likely' WHEN l_quantity<40 THEN 'ambiguous' ELSE 'unknown' END AS cls,
 l_returnflag||(l_suppkey%7)::VARCHAR AS rule, CASE WHEN l_linenumber=1 THEN 'verified' WHEN l_linenumber=2 THEN 'contradicted' ELSE 'none' END AS verification, l_tax>0.07 AS stale, l_orderkey AS ord FROM lineitem)"""


def sites(spark, d):
    li, q = table(spark, d, "lineitem"), F.col("l_quantity")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("site_id"), F.col("l_partkey").alias("caller"), F.col("l_suppkey").alias("target"),
        F.when(q < 10, "proven").when(q < 25, "likely").when(q < 40, "ambiguous").otherwise("unknown").alias("cls"),
        F.concat("l_returnflag", (F.col("l_suppkey") % 7).cast("string")).alias("rule"),
        F.when(F.col("l_linenumber") == 1, "verified").when(F.col("l_linenumber") == 2, "contradicted").otherwise("none").alias("verification"),
        (F.col("l_tax") > 0.07).alias("stale"), F.col("l_orderkey").alias("ord"),
    )


@query("""WITH s AS (SELECT p_partkey, p_name, p_brand FROM part), h AS (SELECT a.p_partkey AS site_id, b.p_partkey AS target_key,
 CASE WHEN EXISTS (SELECT 1 FROM part c WHERE c.p_brand = a.p_brand AND c.p_size = b.p_partkey % 50) THEN 0 WHEN substr(b.p_brand, 8, 1) = '3' THEN 1 ELSE 2 END AS e FROM s a JOIN s b ON a.p_name=b.p_name AND a.p_brand<>b.p_brand),
r AS (SELECT site_id, target_key, row_number() OVER (PARTITION BY site_id ORDER BY e, target_key)-1 AS ordinal, count(*) OVER (PARTITION BY site_id)>25 AS truncated FROM h) SELECT * FROM r WHERE ordinal < 25""")
def resolve_name_candidates(spark, d):
    p = table(spark, d, "part")
    sites = p.select(F.col("p_partkey").alias("site_id"), F.col("p_brand").alias("file_path"), F.col("p_name").alias("callee"))
    known = p.select(F.col("p_brand").alias("file_path"), F.col("p_size").alias("size")).distinct()
    calls = known.join(p, F.col("p_partkey") % 50 == F.col("size")).select("file_path", F.col("p_partkey").alias("target_key"))
    brands = p.select("p_brand").distinct()
    imports = brands.select(F.col("p_brand").alias("file_path")).join(brands.where("substring(p_brand, 8, 1) = '3'").select(F.col("p_brand").alias("imported")))
    return rs.name_candidates(sites, p.select(F.col("p_partkey").alias("symbol_key"), F.col("p_name").alias("name"), F.col("p_brand").alias("path")), calls, imports)


_CAND = """c AS (SELECT l_orderkey AS site_id, l_linenumber AS target_key, l_partkey%5=0 AS receiver_type, l_partkey%3=0 AS peer_members, l_suppkey%2=0 AS arity, l_quantity>25 AS same_directory, l_returnflag AS path, l_linenumber AS start_line, l_linestatus='O' AS is_static FROM lineitem)"""


def _cands(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("site_id"), F.col("l_linenumber").alias("target_key"), (F.col("l_partkey") % 5 == 0).alias("receiver_type"), (F.col("l_partkey") % 3 == 0).alias("peer_members"),
        (F.col("l_suppkey") % 2 == 0).alias("arity"), (F.col("l_quantity") > 25).alias("same_directory"), F.col("l_returnflag").alias("path"), F.col("l_linenumber").alias("start_line"), (F.col("l_linestatus") == "O").alias("is_static"),
    )


@query("WITH " + _CAND + """ SELECT site_id, target_key, points, row_number() OVER (PARTITION BY site_id ORDER BY points DESC, path, start_line, is_static DESC, target_key)-1 AS ordinal FROM
(SELECT *, receiver_type::INT*100+peer_members::INT*20+arity::INT*10+same_directory::INT AS points FROM c)""")
def resolve_rank(spark, d):
    return rs.rank_candidates(_cands(spark, d)).select("site_id", "target_key", "points", "ordinal")


@query("WITH " + _CAND + """, a AS (SELECT *, count(*) FILTER (receiver_type) OVER (PARTITION BY site_id) AS k, count(*) OVER (PARTITION BY site_id) AS n FROM c), b AS (SELECT * FROM a WHERE k=0 OR k=n OR receiver_type),
e AS (SELECT *, count(*) FILTER (arity) OVER (PARTITION BY site_id) AS k2, count(*) OVER (PARTITION BY site_id) AS n2 FROM b) SELECT site_id, target_key FROM e WHERE k2=0 OR k2=n2 OR arity""")
def resolve_narrow(spark, d):
    return rs.narrow(_cands(spark, d), ["receiver_type", "arity"]).select("site_id", "target_key")


@query("WITH " + _SITES + """, q AS (SELECT DISTINCT p_brand AS r FROM part) SELECT DISTINCT s.caller, s.target FROM sites s WHERE NOT stale AND s.target<>s.caller AND (s.rule NOT IN ('R0','R1','A3','N5') OR verification IN ('verified','contradicted'))
AND s.caller IN (SELECT p_partkey FROM part) AND s.target IN (SELECT p_partkey FROM part)""")
def resolve_projection(spark, d):
    q = spark.createDataFrame([("R0",), ("R1",), ("A3",), ("N5",)], "rule string")
    return rs.projection(sites(spark, d), q, table(spark, d, "part").select(F.col("p_partkey").alias("node_key")))


@query("WITH " + _SITES + """, ch AS (SELECT o_orderkey FROM orders WHERE o_orderstatus IS DISTINCT FROM 'O') SELECT site_id, stale OR ord IN (SELECT o_orderkey FROM ch) AS stale FROM sites""")
def resolve_invalidate(spark, d):
    r = sites(spark, d)
    deps = r.select("site_id", F.col("ord").alias("path"), F.lit("O").alias("hash"))
    changed = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("hash"))
    return rs.invalidate(r, deps, changed).select("site_id", "stale")


@query("WITH " + _SITES + """, x AS (SELECT site_id, target, cls, rule, verification, max(CASE WHEN site_id%4<>0 AND ord%2=0 THEN CASE WHEN site_id%3=0 THEN target ELSE target+1 END END) OVER (PARTITION BY site_id) AS found FROM sites)
SELECT site_id, CASE WHEN found IS NULL THEN verification WHEN cls='proven' AND found<>target THEN 'contradicted' ELSE 'verified' END AS verification, coalesce(found,target) AS selected, CASE WHEN found IS NOT NULL AND cls='proven' AND found<>target THEN rule END AS quarantine FROM x""")
def resolve_apply_verification(spark, d):
    r = sites(spark, d)
    res = r.where("ord % 2 = 0").select("site_id", (F.col("site_id") % 4 != 0).alias("is_unique"), F.when(F.col("site_id") % 3 == 0, F.col("target")).otherwise(F.col("target") + 1).alias("found")).withColumn("seq", F.col("found"))
    return rs.apply_verification(r, res)


@query("WITH " + _SITES + ", b AS (SELECT caller AS file_path, CASE WHEN cls='unknown' THEN 'unresolved' ELSE cls END AS b FROM sites) SELECT file_path, count(*) AS total, count(*) FILTER (b='proven') AS proven, count(*) FILTER (b='likely') AS likely, count(*) FILTER (b='ambiguous') AS ambiguous, count(*) FILTER (b='unresolved') AS unresolved, 0::BIGINT AS external, 0::BIGINT AS unsupported, count(*) AS applicable FROM b GROUP BY 1")
def resolve_counters(spark, d):
    return rs.site_counters(sites(spark, d).select(F.col("caller").alias("file_path"), F.when(F.col("cls") == "unknown", "unresolved").otherwise(F.col("cls")).alias("bucket")))


@query("WITH " + _SITES + ", t AS (SELECT *, coalesce(NOT stale AND verification <> 'contradicted' AND (cls = 'proven' OR (verification = 'verified' AND target % 2 = 0)), false) AS ok FROM sites) SELECT site_id, ok, CASE WHEN ok THEN CASE WHEN verification = 'verified' THEN 'tier-b-verified' ELSE 'static-proof' END END AS label, CASE WHEN stale THEN 'unknown' ELSE cls END AS shown, CASE WHEN NOT stale AND cls='likely' THEN 0.5 END AS confidence FROM t")
def resolve_trusted(spark, d):
    r = sites(spark, d)
    cls, conf = rs.masked(F.col("cls"), F.lit(0.5), F.col("stale"))
    ok = rs.trusted(F.col("cls"), F.col("target"), F.col("stale"), F.col("verification"), F.col("target") + F.col("target") % 2)
    return r.select("site_id", ok.alias("ok"), rs.evidence_label(ok, F.col("verification")).alias("label"), cls.alias("shown"), conf.alias("confidence"))


@query("""WITH g AS (SELECT l_orderkey AS site_id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS c, list(l_partkey ORDER BY l_linenumber, l_partkey) FILTER (l_partkey <> 0) AS x, min(l_partkey) AS s, l_orderkey % 3 AS k, l_orderkey % 7 = 0 AS stale FROM lineitem GROUP BY l_orderkey)
SELECT site_id, CASE WHEN k = 0 AND NOT stale THEN list_slice(list_filter(c, lambda v: v <> s), 1, 2) ELSE [] END AS alternatives, CASE WHEN k = 1 AND NOT stale THEN list_slice(c, 1, 3) ELSE [] END AS ambiguous FROM g""")
def resolve_alternatives(spark, d):
    k = F.col("site_id") % 3
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("site_id")).agg(
        F.collect_list(F.struct(F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("target"))).alias("c"), F.min("l_partkey").alias("s")
    )
    others, ambiguous = rs.alternatives(F.col("c"), F.col("s"), F.when(k == 0, "likely").when(k == 1, "ambiguous").otherwise("proven"), F.col("site_id") % 7 == 0)
    return g.select("site_id", others.alias("alternatives"), ambiguous.alias("ambiguous"))


@query("WITH " + _SITES + ", g AS (SELECT rule, ord AS grp, bool_and(site_id%1000<>0) AS ok FROM sites GROUP BY 1,2), s AS (SELECT rule, count(*) AS n_groups, count(*) FILTER (NOT ok) AS wrong FROM g GROUP BY 1) SELECT rule, n_groups, wrong, (wrong=0 AND n_groups>=299) AS certified FROM s")
def resolve_certification(spark, d):
    u = sites(spark, d).select("rule", F.col("ord").alias("grp"), (F.col("site_id") % 1000 != 0).alias("exact"))
    return rs.certification(u).select("rule", "n_groups", "wrong", "certified")


@query("""WITH i AS (SELECT c_custkey AS f, c_nationkey AS l, c_nationkey AS o, c_mktsegment AS m FROM customer), e AS (SELECT DISTINCT c_mktsegment AS module, s_nationkey AS name, 'function' AS kind FROM customer, (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey<6) WHERE c_mktsegment='BUILDING'),
en AS (SELECT module, name, count(*) AS n FROM e GROUP BY 1,2), ow AS (SELECT name, count(*) AS n FROM e GROUP BY 1)
SELECT i.f AS site_id, CASE WHEN en.n=1 AND ow.n=1 THEN i.m||'#'||i.o::VARCHAR END AS target, CASE WHEN coalesce(en.n,0)<>1 THEN 'unresolved-call-binding' WHEN ow.n<>1 THEN 'no-unique-owner-candidate' END AS reason FROM i LEFT JOIN en ON en.module=i.m AND en.name=i.o LEFT JOIN ow ON ow.name=i.o""")
def resolve_named_import(spark, d):
    c = table(spark, d, "customer")
    st = c.select(F.col("c_custkey").alias("site_id"), F.col("c_custkey").alias("file_path"), F.col("c_nationkey").alias("callee"))
    im = c.select(F.col("c_custkey").alias("file_path"), F.col("c_nationkey").alias("local"), F.col("c_nationkey").alias("original"), F.col("c_mktsegment").alias("module"))
    ex = table(spark, d, "supplier").where("s_nationkey < 6").select(F.lit("BUILDING").alias("module"), F.col("s_nationkey").alias("name"), F.lit("function").alias("kind")).distinct()
    ex = ex.join(c.where("c_mktsegment = 'BUILDING'").select("c_mktsegment").distinct(), F.col("module") == F.col("c_mktsegment"), "left_semi")
    return rs.named_import_proof(st, im, ex)


@query("SELECT coalesce(a.p,b.p) AS path, CASE WHEN a.p IS NULL THEN 'added' WHEN b.p IS NULL THEN 'removed' ELSE 'modified' END AS change FROM (SELECT l_partkey AS p, max(l_shipdate) AS h FROM lineitem WHERE l_linestatus='O' GROUP BY 1) a FULL JOIN (SELECT l_partkey AS p, max(l_shipdate) AS h FROM lineitem WHERE l_returnflag<>'R' GROUP BY 1) b ON a.p=b.p WHERE a.p IS NULL OR b.p IS NULL OR a.h IS DISTINCT FROM b.h")
def maintain_hash_diff(spark, d):
    li = table(spark, d, "lineitem")
    side = lambda w: li.where(w).groupBy(F.col("l_partkey").alias("path")).agg(F.max("l_shipdate").alias("hash"))
    return mt.hash_diff(side("l_linestatus = 'O'"), side("l_returnflag <> 'R'"))


@query("""WITH x AS (SELECT project_id, sha256(coalesce(node_type,'')||chr(10)||coalesce(title,'')||chr(10)||coalesce(content,'')) AS hash, commit_sha AS commit, decision_id AS seq FROM decisions), p AS (SELECT project_id, hash, commit, min(seq) AS seq, count(*) AS c FROM x GROUP BY 1,2,3)
SELECT project_id, hash, sum(c)::BIGINT AS times, list(commit ORDER BY seq, commit) AS commits, min(seq) AS first_seq FROM p GROUP BY 1,2""")
def maintain_upsert_decisions(spark, d):
    x = table(spark, d, "decisions").select("project_id", text.decision_hash(F.col("node_type"), F.col("title"), F.col("content")).alias("hash"), F.col("commit_sha").alias("commit"), F.col("decision_id").alias("seq"))
    return mt.upsert_decisions(x.where("seq % 2 = 0"), x.where("seq % 2 = 1"))


@query(r"""WITH x AS (SELECT l2_node_key AS anchor, lower(trim(regexp_replace(title,'\s+',' ','g'))) AS title, trim(regexp_replace(content,'\s+',' ','g')) AS content FROM decisions WHERE coalesce(validity_status,'')<>'garbage' AND title IS NOT NULL AND content IS NOT NULL AND l2_node_key IS NOT NULL)
SELECT anchor, title, count(DISTINCT content) AS contents FROM x GROUP BY 1,2 HAVING count(DISTINCT content)>1""")
def maintain_contradictions(spark, d):
    return mt.contradictions(table(spark, d, "decisions").withColumnRenamed("l2_node_key", "anchor"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS p, (o_orderkey%10)::INT AS a, (o_orderkey%10+3)::INT AS b, (o_custkey%3)::INT AS c FROM orders), w AS (SELECT c_custkey AS p, l::INT AS line, CASE WHEN l=7 THEN 9 ELSE (c_custkey%3)::INT END AS owner FROM customer, range(0,13) t(l)),
v AS (SELECT id, bool_and(owner=c) AS alive FROM r JOIN w ON w.p=r.p AND line BETWEEN a AND b GROUP BY 1) SELECT o_orderkey AS decision_id, CASE WHEN o_orderstatus='P' THEN 'garbage' WHEN alive IS NULL THEN 'pending' WHEN alive THEN 'active' ELSE 'garbage' END AS status FROM orders LEFT JOIN v ON v.id=o_orderkey""")
def maintain_validity(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    k = F.col("o_orderkey")
    ranges = o.select(k.alias("decision_id"), F.col("o_custkey").alias("path"), (k % 10).alias("start_line"), (k % 10 + 3).alias("end_line"), (F.col("o_custkey") % 3).alias("commit"))
    owners = c.select(F.col("c_custkey").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(12))).alias("line")).withColumn("owner", F.when(F.col("line") == 7, 9).otherwise(F.col("path") % 3))
    dec = o.select(k.alias("decision_id"), F.when(F.col("o_orderstatus") == "P", "garbage").otherwise("pending").alias("status"))
    return mt.validity(dec, ranges, owners)


@query("SELECT user_id, event_type, position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i, min(event_id) OVER (PARTITION BY user_id) AS position FROM events) WHERE i=1")
def maintain_queue_upsert(spark, d):
    return mt.queue_upsert(table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_type", "position")


@query("WITH " + _SITES + """, r AS (SELECT caller % 500 AS file, rule, CASE WHEN stale OR verification = 'contradicted' THEN 0 WHEN cls = 'likely' THEN 1 WHEN cls = 'proven' THEN 2 ELSE 0 END AS p FROM sites WHERE cls IN ('likely', 'proven') AND caller % 5 <> 1),
m AS (SELECT file, min(p) AS p FROM r GROUP BY 1), g AS (SELECT file, p, array_to_string(list_sort(list(DISTINCT rule)), chr(1)) AS s FROM r JOIN m USING (file, p) GROUP BY 1, 2),
q AS (SELECT p_partkey % 500 AS file, p_brand AS commit_sha, p_partkey AS idx FROM part)
SELECT file, commit_sha, idx, row_number() OVER (ORDER BY coalesce(p, 0), coalesce(s, ''), file, commit_sha, idx) AS position FROM q LEFT JOIN g USING (file)""")
def maintain_queue_order(spark, d):
    r = sites(spark, d).where("cls IN ('likely', 'proven') AND caller % 5 <> 1").select((F.col("caller") % 500).alias("file"), "cls", "stale", "verification", F.col("rule").alias("signature"))
    q = table(spark, d, "part").select((F.col("p_partkey") % 500).alias("file"), F.col("p_brand").alias("commit_sha"), F.col("p_partkey").alias("idx"))
    return mt.queue_order(q, r)


@query("""WITH f AS (SELECT user_id AS key, event_id AS seq, event_type='purchase' AS ok FROM events), o AS (SELECT key, max(seq) FILTER (ok) AS a FROM f GROUP BY 1), b AS (SELECT f.key FROM f JOIN o USING (key) WHERE NOT f.ok AND f.seq>coalesce(a,-1) GROUP BY 1 HAVING count(*)>=3) SELECT DISTINCT user_id AS key FROM events WHERE user_id NOT IN (SELECT key FROM b)""")
def maintain_evict(spark, d):
    e = table(spark, d, "events")
    f = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("ok"))
    return mt.evict(f.select("key").distinct(), f)


@query("""SELECT event_id, nth, spent, (nth<=3 AND spent<=150) AS allowed FROM (SELECT event_id, count(*) OVER w AS nth, sum(event_id%100) OVER w::BIGINT AS spent FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))""".replace("OVER w::BIGINT", "OVER w"))
def maintain_budget(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), (F.col("event_id") % 100).alias("tokens"))
    return mt.within_budget(e, 3, 150).select(F.col("id").alias("event_id"), "nth", "spent", "allowed")


@query("""WITH t AS (SELECT user_id AS key, event_id AS seq, event_type='purchase' AS progressed FROM events WHERE event_type<>'view'), g AS (SELECT *, sum(progressed::INT) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM t),
s AS (SELECT key, seq, sum((NOT progressed)::INT) OVER (PARTITION BY key, g ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM g) SELECT key, seq, streak, streak>0 AND streak%3=0 AS escalate FROM s""")
def maintain_zero_progress(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") != "view").alias("attempted"), (F.col("event_type") == "purchase").alias("progressed"))
    return mt.zero_progress(e)


@query("""SELECT key, seq, total, total>=512000 AND total-bytes<512000 AS trigger FROM (SELECT repo_id AS key, task_id AS seq, coalesce(n_bytes,0) AS bytes, sum(coalesce(n_bytes,0)) OVER (PARTITION BY repo_id ORDER BY task_id ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM (SELECT DISTINCT ON (task_id) * FROM parse_requests))""")
def maintain_trigger(spark, d):
    p = table(spark, d, "parse_requests").dropDuplicates(["task_id"]).select(F.col("repo_id").alias("key"), F.col("task_id").alias("seq"), F.col("n_bytes").alias("bytes"))
    return mt.triggered(p)


@query("""WITH p AS (SELECT source AS grp, doc_id AS id, n_chars%97 AS confidence, coalesce(doc_kind,'') AS title, 6+length(coalesce(lang,'node'))+length(coalesce(doc_kind,''))+least(length(coalesce(text,'')),500) AS size FROM documents WHERE coalesce(n_chars%97,1)>=3),
u AS (SELECT *, sum(size) OVER (PARTITION BY grp ORDER BY coalesce(confidence,0) DESC, title, id ROWS UNBOUNDED PRECEDING) AS upto FROM p) SELECT grp, id, size, upto<=8000 AS kept FROM u""")
def maintain_budget_prefix(spark, d):
    p = table(spark, d, "documents").select(F.col("source").alias("grp"), F.col("doc_id").alias("id"), (F.col("n_chars") % 97).cast("double").alias("confidence"), F.col("lang").alias("node_type"), F.coalesce("doc_kind", F.lit("")).alias("title"), "text")
    return mt.budget_prefix(p, least_confidence=3.0).withColumn("size", F.col("size").cast("long"))


@query("SELECT grp, id FROM (SELECT source AS grp, doc_id AS id, row_number() OVER (PARTITION BY source, doc_kind, substr(text,1,200) ORDER BY n_chars DESC, doc_id) AS i FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL) WHERE i=1")
def maintain_compress(spark, d):
    p = table(spark, d, "documents").where("text IS NOT NULL AND n_chars IS NOT NULL").select(F.col("source").alias("grp"), F.col("doc_id").alias("id"), F.col("doc_kind").alias("title"), F.col("n_chars").alias("confidence"), "text")
    return mt.compress(p).select("grp", "id")


@query("SELECT p_partkey, CASE WHEN p_size%5=0 OR p_size%7=0 THEN 'unknown' WHEN p_size%3=0 THEN 'fresh' ELSE 'stale' END AS state FROM part")
def maintain_freshness(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", mt.freshness(F.when(s % 5 != 0, F.lit("a")), F.when(s % 7 != 0, F.when(s % 3 == 0, "a").otherwise("b"))).alias("state"))


@query("SELECT 'decisions' AS metric, count(*) AS value FROM decisions UNION ALL SELECT 'files', count(*) FROM file_changes UNION ALL SELECT 'queue', count(*) FROM pending_batches")
def maintain_status(spark, d):
    return mt.status(decisions=table(spark, d, "decisions"), files=table(spark, d, "file_changes"), queue=table(spark, d, "pending_batches"))


@query("""WITH m AS (SELECT 'coverage' AS metric, count(*) FILTER (l_quantity>30) AS good, count(*) AS total FROM lineitem UNION ALL SELECT 'resolution', count(*) FILTER (l_quantity>40), count(*) FROM lineitem UNION ALL SELECT 'empty', 0, 0)
SELECT metric, good, total, CASE WHEN total=0 THEN 1.0 ELSE good/total END AS rate, CASE WHEN total>0 AND good/total<0.5 THEN CASE WHEN metric='coverage' THEN 'fail' ELSE 'note' END ELSE 'ok' END AS verdict FROM m""")
def maintain_health(spark, d):
    li = table(spark, d, "lineitem")
    m = lambda n, w: li.agg(F.count_if(F.expr(w)).alias("good"), F.count(F.lit(1)).alias("total")).select(F.lit(n).alias("metric"), "good", "total")
    none = li.where("1 = 0").agg(F.count(F.lit(1)).alias("good"), F.count(F.lit(1)).alias("total")).select(F.lit("empty").alias("metric"), "good", "total")
    return mt.health(m("coverage", "l_quantity > 30").unionAll(m("resolution", "l_quantity > 40")).unionAll(none))


@query("""SELECT DISTINCT decision_id FROM decisions WHERE l2_node_key IN (SELECT string_split(target_key, '#')[1] FROM graph_edges UNION SELECT string_split(source_key, '#')[1] FROM graph_edges) AND content_hash IS NOT NULL AND content_hash NOT IN (SELECT lower(h) FROM (SELECT unnest(synced_content_hashes) AS h FROM sync_states) WHERE h IS NOT NULL)
UNION SELECT DISTINCT decision_id FROM decisions WHERE decision_id % 3 = 0 AND content_hash IS NOT NULL AND content_hash NOT IN (SELECT lower(h) FROM (SELECT unnest(synced_content_hashes) AS h FROM sync_states) WHERE h IS NOT NULL)""")
def maintain_publish(spark, d):
    e, all_dec = table(spark, d, "graph_edges"), table(spark, d, "decisions")
    ch = e.select(F.explode(F.array("source_key", "target_key")).alias("k")).select(F.substring_index("k", "#", 1).alias("node_key"))
    dec = all_dec.where("content_hash IS NOT NULL").select("decision_id", F.when(F.col("decision_id") % 3 == 0, "changed").otherwise(F.col("l2_node_key")).alias("node_key"), F.col("content_hash").alias("hash"))
    both = dec.unionByName(all_dec.where("content_hash IS NOT NULL").select("decision_id", F.col("l2_node_key").alias("node_key"), F.col("content_hash").alias("hash")))
    sy = table(spark, d, "sync_states").select(F.explode("synced_content_hashes").alias("h")).select(F.lower("h").alias("hash"))
    return mt.publishable(ch.unionByName(spark.createDataFrame([("changed",)], "node_key string")), both, sy).select("decision_id").distinct()


@query("""WITH c AS (SELECT project_id, commit_seq, string_split(trim(file_path),'/') AS p FROM file_changes WHERE project_id IS NOT NULL AND commit_seq IS NOT NULL), l AS (SELECT project_id, commit_seq, row_number() OVER (PARTITION BY project_id ORDER BY commit_seq DESC) AS i FROM (SELECT DISTINCT project_id, commit_seq FROM c)),
x AS (SELECT project_id, CASE WHEN len(p)<=1 OR p[1] LIKE '.%' OR p[1] IN ('node_modules','dist','build','docs','test','tests','scripts') THEN NULL ELSE (SELECT CASE WHEN x LIKE '%.%' OR x IN ('src','lib','app') THEN NULL ELSE x END FROM (SELECT CASE WHEN p[1]='src' THEN p[2] WHEN len(p)>3 AND p[1] IN ('packages','artifacts','crates') AND p[3]='src' THEN p[2] ELSE p[1] END AS x)) END AS domain FROM c JOIN l USING (project_id, commit_seq) WHERE i <= 100), n AS (SELECT project_id, domain, count(*) AS n FROM x WHERE domain IS NOT NULL GROUP BY 1, 2)
SELECT project_id, domain, n FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, domain) AS i FROM n) WHERE i <= 5""")
def maintain_hotspots(spark, d):
    return mt.hotspots(table(spark, d, "file_changes"), text.domain(F.col("file_path")), "project_id", "commit_seq")
