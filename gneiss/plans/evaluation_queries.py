"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import stats, text
from gneiss.operators import evaluation as ev
from gneiss.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def scored(spark, d):
    """Observations for calibration: lineitem rows with a score in [0, 1] and an outcome that follows it loosely."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("model"), F.concat("l_returnflag", F.lit("-"), F.col("l_suppkey").cast("string")).alias("grp"), F.col("l_linestatus").alias("family"),
        ((F.col("l_partkey") * 7 + F.col("l_orderkey")) % 1000 / 1000.0).alias("score"),
        ((F.col("l_orderkey") * 13 + F.col("l_linenumber")) % 1000 < (F.col("l_partkey") * 7 + F.col("l_orderkey")) % 1000).alias("positive"),
    )


S = """WITH s AS (SELECT l_returnflag AS model, l_returnflag||'-'||l_suppkey::VARCHAR AS grp, l_linestatus AS family, ((l_partkey*7+l_orderkey)%1000)/1000.0::DOUBLE AS score,
 ((l_orderkey*13+l_linenumber)%1000) < ((l_partkey*7+l_orderkey)%1000) AS positive FROM lineitem)"""


@query("""WITH x AS (SELECT DISTINCT p_brand AS grp, l_suppkey AS item FROM lineitem JOIN part ON p_partkey=l_partkey), n AS (SELECT grp, count(*) AS n FROM x GROUP BY 1),
s AS (SELECT a.grp AS a, b.grp AS b, count(*) AS shared FROM x a JOIN x b ON a.item=b.item AND a.grp<b.grp GROUP BY 1,2)
SELECT a, b, shared, shared/least(x.n,y.n) AS overlap FROM s JOIN n x ON x.grp=a JOIN n y ON y.grp=b WHERE shared/least(x.n,y.n) >= 0.2""")
def eval_family_relations(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    return ev.family_relations(li.join(p, li.l_partkey == p.p_partkey).select(F.col("p_brand").alias("grp"), F.col("l_suppkey").alias("item")))


_CS = "SELECT DISTINCT sample_id, lower(trim(split)) AS split, CASE WHEN length(trim(duplicate_group))=64 AND NOT regexp_matches(duplicate_group,'^0+$') THEN lower(duplicate_group) END AS grp FROM corpus_samples"


@query("WITH i AS (" + _CS + """), p AS (SELECT *, CASE split WHEN 'test' THEN 0 WHEN 'temporal' THEN 1 WHEN 'calibration' THEN 2 WHEN 'train' THEN 3 END AS p FROM i)
SELECT sample_id, split, grp FROM (SELECT *, min(p) OVER (PARTITION BY grp) AS m FROM p) WHERE grp IS NULL OR p=m""")
def eval_priority_split(spark, d):
    g = F.col("duplicate_group")
    i = table(spark, d, "corpus_samples").select(
        "sample_id", F.lower(F.trim("split")).alias("split"), F.when((F.length(F.trim(g)) == 64) & ~g.rlike("^0+$"), F.lower(g)).alias("grp")
    )
    return ev.keep_priority_split(i.distinct())


@query("""SELECT sample_id, CASE WHEN collected_at IS NULL THEN 'stale' WHEN review_status='conflict' THEN 'conflict' WHEN review_status='out-of-scope' THEN 'out-of-scope' WHEN coalesce(oracle_status,'')<>'resolved' THEN 'oracle-unresolved'
 WHEN coalesce(review_status,'unreviewed')='unreviewed' THEN 'unreviewed' WHEN coalesce(truncated,false) THEN 'truncated' WHEN coalesce(len(positive_target_ids),0)=0 THEN 'no-positive' ELSE 'ready' END AS state FROM (SELECT DISTINCT ON (sample_id) * FROM corpus_samples)""")
def eval_labels(spark, d):
    s = table(spark, d, "corpus_samples").dropDuplicates(["sample_id"])
    return s.select("sample_id", ev.label_state(F.col("oracle_status"), F.col("review_status"), F.col("truncated"), F.col("positive_target_ids"), F.col("collected_at").isNotNull()).alias("state"))


@query("""WITH r AS (SELECT code_language, list_distinct(positive_target_ids) AS p, list_distinct(list_transform(candidates, lambda x: x.target_id)) AS c FROM corpus_samples WHERE len(positive_target_ids)>0),
h AS (SELECT *, len(list_filter(p, lambda x: list_contains(c, x))) AS k FROM r) SELECT code_language, sum(k)/sum(len(p)) AS recall, avg((k=len(p))::INT) AS "full" FROM h GROUP BY 1""")
def eval_candidate_recall(spark, d):
    r = table(spark, d, "corpus_samples").select("code_language", F.col("positive_target_ids").alias("positives"), F.col("candidates.target_id").alias("candidates"))
    return ev.candidate_recall(r, ["code_language"])


@query(S + " SELECT grp, count(*) AS n, bool_and(positive) AS exact FROM s GROUP BY 1")
def eval_collapse_groups(spark, d):
    return ev.collapse_groups(scored(spark, d).withColumnRenamed("positive", "exact"))


@query("""SELECT l_shipmode_like AS split, count(*) AS total, count(*) FILTER (a) AS exportable, count(*) FILTER (a AND b) AS labelled, count(*) FILTER (a AND b AND c) AS with_candidates, count(*) FILTER (a AND b AND c AND e) AS reachable,
count(*) FILTER (a AND b AND c AND e AND f) AS committed, count(*) FILTER (a AND b AND c AND e AND f AND g) AS exact FROM (SELECT l_returnflag AS l_shipmode_like, l_quantity>5 AS a, l_discount>0.01 AS b, l_tax<0.08 AS c, l_linenumber<6 AS e, l_partkey%3<>0 AS f, l_suppkey%5<>0 AS g FROM lineitem) GROUP BY 1""")
def eval_funnel(spark, d):
    li = table(spark, d, "lineitem")
    return ev.funnel(li.select(
        F.col("l_returnflag").alias("split"), (F.col("l_quantity") > 5).alias("exportable"), (F.col("l_discount") > 0.01).alias("labelled"), (F.col("l_tax") < 0.08).alias("with_candidates"),
        (F.col("l_linenumber") < 6).alias("reachable"), (F.col("l_partkey") % 3 != 0).alias("committed"), (F.col("l_suppkey") % 5 != 0).alias("exact"),
    ), ["split"])


@query(S + " SELECT least(14, floor(score*15))::INT AS bin, count(*) AS n, avg(score) AS mean_score, avg(positive::INT) AS accuracy FROM s GROUP BY 1")
def eval_reliability(spark, d):
    return ev.reliability(scored(spark, d))


@query(S + ", r AS (SELECT least(14, floor(score*15))::INT AS bin, count(*) AS n, avg(score) AS m, avg(positive::INT) AS a FROM s GROUP BY 1) SELECT (SELECT count(*) FROM s) AS n, sum(n*abs(m-a))/(SELECT count(*) FROM s) AS ece, (SELECT avg((score-positive::INT)*(score-positive::INT)) FROM s) AS brier FROM r")
def eval_calibration_error(spark, d):
    return ev.calibration_error(scored(spark, d)).select("n", "ece", "brier")


@query(S + ", p AS (SELECT score, count(*) AS c, count(*) FILTER (NOT positive) AS e FROM s GROUP BY 1), w AS (SELECT score AS threshold, sum(c) OVER (ORDER BY score DESC)::BIGINT AS committed, sum(e) OVER (ORDER BY score DESC)::BIGINT AS errors FROM p) SELECT threshold, committed, errors, committed/(SELECT count(*) FROM s) AS coverage, errors/committed AS risk FROM w")
def eval_risk_coverage(spark, d):
    return ev.risk_coverage(scored(spark, d))


@query()
def eval_certify_threshold(spark, d):
    return ev.certify_threshold(scored(spark, d), 0.4)


@query()
def eval_isotonic(spark, d):
    return ev.isotonic_fit(scored(spark, d), "model")


@query("""WITH p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, min(value) AS least, max(value) AS largest, min(value) FILTER (i >= ceil(0.5*n)) AS p50, min(value) FILTER (i >= ceil(0.95*n)) AS p95 FROM p GROUP BY 1""")
def eval_percentiles(spark, d):
    return ev.nearest_rank(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query(S + ", a AS (SELECT family, avg(positive::INT) AS a FROM s GROUP BY 1) SELECT count(*) AS families, avg(a) AS macro FROM a")
def eval_macro(spark, d):
    return ev.macro_accuracy(scored(spark, d), "family")


@query("""WITH r AS (SELECT o_custkey AS case_id, list_distinct(list(o_orderpriority)) AS e, list_distinct(coalesce(list(o_orderpriority) FILTER (o_totalprice > 150000), []::VARCHAR[])) AS g FROM orders GROUP BY 1),
h AS (SELECT *, len(list_filter(e, lambda x: list_contains(g, x))) AS k FROM r), s AS (SELECT case_id, CASE WHEN len(e)=0 AND len(g)=0 THEN 1.0 WHEN len(g)=0 THEN 0.0 ELSE k/len(g) END::DOUBLE AS precision, (CASE WHEN len(e)=0 THEN 0.0 ELSE k/len(e) END)::DOUBLE AS recall FROM h)
SELECT case_id, precision, recall, CASE WHEN precision+recall>0 THEN 2*precision*recall/(precision+recall) ELSE 0.0 END::DOUBLE AS f1 FROM s""")
def eval_set_scores(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(
        F.collect_set("o_orderpriority").alias("expected"), F.collect_set(F.when(F.col("o_totalprice") > 150000, F.col("o_orderpriority"))).alias("found")
    )
    return ev.set_scores(o)


@query("""WITH r AS (SELECT o_orderpriority, o_orderkey, o_orderstatus, sha256('s1'||chr(0)||o_orderkey::VARCHAR) AS h FROM orders), w AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM r)
SELECT o_orderpriority, o_orderkey FROM w WHERE i <= ceil(n*0.1) OR o_orderstatus='P'""")
def eval_audit_sample(spark, d):
    o = table(spark, d, "orders").withColumn("conflict", F.col("o_orderstatus") == "P")
    return ev.audit_sample(o, "o_orderpriority", "o_orderkey", "s1", 0.1, "conflict").select("o_orderpriority", "o_orderkey")


@query(S + ", p AS (SELECT model AS family, count(*) AS n, sum(positive::INT) AS k FROM s GROUP BY 1) SELECT family, n AS n_test, (SELECT sum(n) FROM p)::BIGINT - n AS n_train, ((SELECT sum(k) FROM p) - k)/((SELECT sum(n) FROM p) - n) AS train_accuracy FROM p")
def eval_leave_one_out(spark, d):
    return ev.leave_one_family_out(scored(spark, d), "model")


@query(S + f", c AS (SELECT model, count(*) FILTER (positive) AS k, count(*) AS n FROM s GROUP BY 1), p AS (SELECT *, k/n AS p, {stats.Z} AS z FROM c) SELECT model, k, n, greatest(0.0, (p+z*z/(2*n)-z*sqrt(p*(1-p)/n+z*z/(4*n*n)))/(1+z*z/n)) AS low, least(1.0, (p+z*z/(2*n)+z*sqrt(p*(1-p)/n+z*z/(4*n*n)))/(1+z*z/n)) AS high FROM p")
def eval_wilson(spark, d):
    c = scored(spark, d).groupBy("model").agg(F.count_if("positive").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return c.select("model", "k", "n", low.alias("low"), high.alias("high"))


@query("SELECT l_orderkey, l_linenumber, (CASE l_linenumber WHEN 1 THEN 0.9 WHEN 2 THEN 0.55 WHEN 3 THEN 0.3 END)/(1+log2(greatest(l_quantity,1))) AS score FROM lineitem")
def eval_baseline(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ev.baseline_score(F.col("l_linenumber") - 1, F.col("l_quantity")).alias("score"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax=0 OR l_returnflag='R' THEN 'verify' WHEN l_discount>=0.06 THEN 'commit' WHEN l_quantity<3 AND l_tax>l_discount THEN 'unknown' ELSE 'verify' END AS decision FROM lineitem")
def eval_decisions(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", ev.decide(
        F.col("l_tax") != 0, F.when(F.col("l_returnflag") != "R", F.lit(0.06)), F.col("l_discount"), F.when(F.col("l_quantity") < 3, 0).otherwise(1), F.col("l_tax"), F.col("l_discount")
    ).alias("decision"))


@query("""SELECT DISTINCT sample_id, CASE WHEN list_has_any(coalesce(positive_target_ids, []), coalesce(negative_target_ids, [])) OR review_status = 'conflict' THEN 'label-conflict' WHEN coalesce(review_status, '') <> 'confirmed' THEN 'review-status-not-confirmed'
 WHEN coalesce(oracle_status, '') <> 'resolved' THEN 'oracle-not-resolved' WHEN len(coalesce(positive_target_ids, [])) = 0 THEN 'empty-positive-target-set' END AS reason FROM corpus_samples""")
def eval_exclusions(spark, d):
    c = table(spark, d, "corpus_samples")
    return c.select("sample_id", ev.exclusion_reason(F.col("positive_target_ids"), F.col("negative_target_ids"), F.col("review_status"), F.col("oracle_status")).alias("reason")).distinct()


@query("""SELECT DISTINCT sample_id, list_sort(list_distinct(oracle_target_ids)) = list_sort(list_distinct(positive_target_ids)) AS same, 'tierA:' || substr(sha256(callee_name), 1, 16) AS id FROM corpus_samples WHERE oracle_target_ids IS NOT NULL AND positive_target_ids IS NOT NULL AND len(list_filter(oracle_target_ids, lambda x: x IS NULL)) = 0""")
def eval_exact_sets(spark, d):
    c = table(spark, d, "corpus_samples").where("oracle_target_ids IS NOT NULL AND positive_target_ids IS NOT NULL AND NOT exists(oracle_target_ids, x -> x IS NULL)")
    return c.select("sample_id", ev.same_set(F.col("oracle_target_ids"), F.col("positive_target_ids")).alias("same"), text.candidate_id(F.col("callee_name")).alias("id")).distinct()


@query("SELECT split, count(*) AS n, count(DISTINCT duplicate_group) AS groups, count(DISTINCT repo_family) AS families FROM corpus_samples GROUP BY 1")
def eval_groups_by_split(spark, d):
    c = table(spark, d, "corpus_samples")
    return ev.groups_by_split(c.select("split", F.col("duplicate_group").alias("grp"), F.col("repo_family").alias("family")))


_OOF = "r AS (SELECT l_orderkey AS grp, l_returnflag || l_linestatus AS family, l_quantity > 2 AS exact FROM lineitem), g AS (SELECT grp, bool_and(exact) AS exact FROM r GROUP BY 1)"


def _committed(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey AS grp", "concat(l_returnflag, l_linestatus) AS family", "l_quantity > 2 AS exact")


@query("WITH " + _OOF + " SELECT 'pool' AS family, count(*) AS commits, count(*) FILTER (exact) AS exact FROM g UNION ALL SELECT family, count(*), count(*) FILTER (exact) FROM (SELECT DISTINCT grp, family FROM r) JOIN g USING (grp) GROUP BY 1")
def eval_out_of_fold(spark, d):
    pool, families = ev.out_of_fold(_committed(spark, d))
    return pool.select(F.lit("pool").alias("family"), F.col("groups").alias("commits"), F.col("exact_groups").alias("exact")).unionByName(families)


@query("WITH " + _OOF + ", f AS (SELECT family, count(*) AS n, count(*) FILTER (exact) AS k FROM (SELECT DISTINCT grp, family FROM r) JOIN g USING (grp) GROUP BY 1) SELECT bool_and(n < 200 OR k / n >= 0.85) AS passes FROM f")
def eval_family_gate(spark, d):
    return ev.family_gate(ev.out_of_fold(_committed(spark, d))[1], 0.85)


@query("""WITH c AS (SELECT p_size::DOUBLE AS threshold, avg(p_partkey % 2) AS bound, min(p_partkey) % 2 = 0 AS gate FROM part GROUP BY 1), s AS (SELECT * FROM c WHERE bound >= 0.5 AND gate)
SELECT 'selected' AS kind, min(threshold) AS threshold, min_by(bound, threshold) AS bound FROM s HAVING count(*) > 0 UNION ALL SELECT 'best', t, b FROM (SELECT threshold AS t, bound AS b FROM c ORDER BY bound DESC, threshold LIMIT 1)
UNION ALL SELECT 'strictest', max(threshold), max_by(bound, threshold) FROM c UNION ALL SELECT 'least-strict', min(threshold), min_by(bound, threshold) FROM c""")
def eval_select_threshold(spark, d):
    c = table(spark, d, "part").groupBy(F.col("p_size").cast("double").alias("threshold")).agg(F.avg(F.col("p_partkey") % 2).alias("bound"), (F.min("p_partkey") % 2 == 0).alias("gate"))
    return ev.select_threshold(c, 0.5)


@query("""WITH k AS (SELECT unnest(list_distinct([p_brand, 'size' || (p_size % 3)])) AS slice, p_partkey % 2 = 0 AS positive FROM part), d AS (SELECT DISTINCT p_brand AS slice FROM part UNION SELECT unnest(['size0', 'size1', 'size2', 'size3']))
SELECT d.slice, count(k.slice) AS n, count(*) FILTER (positive) AS positives FROM d LEFT JOIN k USING (slice) GROUP BY 1""")
def eval_slices(spark, d):
    p = table(spark, d, "part")
    dimension = p.select(F.col("p_brand").alias("slice")).union(spark.createDataFrame([(f"size{i}",) for i in range(4)], "slice string"))
    return ev.slices(p.withColumn("positive", F.col("p_partkey") % 2 == 0), F.array("p_brand", F.concat(F.lit("size"), (F.col("p_size") % 3).cast("string"))), dimension)
