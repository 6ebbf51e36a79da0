"""Evaluation of resolvers and corpora: duplicates, splits, calibration, curves, funnels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.stats import exact_lower_bound, isotonic, rate

PRIORITY = {"test": 0, "temporal": 1, "calibration": 2, "train": 3}


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two arrays as sets; 0 if either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def family_relations(items: DataFrame, least: float = 0.2) -> DataFrame:
    """(a, b, shared, overlap): groups whose element sets overlap.

    items: (grp, item). Counted over an equi-join on the items, so groups
    without a common item never meet. a < b.
    """
    x = items.dropna().distinct()
    n = x.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    left, right = x.withColumnRenamed("grp", "a"), x.withColumnRenamed("grp", "b")
    shared = left.join(right, "item").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    na, nb = n.select(F.col("grp").alias("a"), F.col("n").alias("na")), n.select(F.col("grp").alias("b"), F.col("n").alias("nb"))
    out = shared.join(na, "a").join(nb, "b").select("a", "b", "shared", (F.col("shared") / F.least("na", "nb")).alias("overlap"))
    return out.where(F.col("overlap") >= least)


def split_priority(split: Column) -> Column:
    """Rank of a split, null for others."""
    return F.coalesce(*[F.when(split == s, p) for s, p in PRIORITY.items()])


def keep_priority_split(items: DataFrame) -> DataFrame:
    """Rows whose split is the first by priority of their duplicate group; rows without group stay."""
    p = split_priority(F.col("split"))
    best = items.where("grp IS NOT NULL").groupBy("grp").agg(F.min(p).alias("best"))
    return items.join(best, "grp", "left").where(F.col("grp").isNull() | (p == F.col("best"))).drop("best")


def label_state(oracle: Column, review: Column, truncated: Column, positives: Column, fresh: Column) -> Column:
    """State of a label; the first rule that holds decides."""
    return (
        F.when(~F.coalesce(fresh, F.lit(False)), "stale").when(review == "conflict", "conflict").when(review == "out-of-scope", "out-of-scope")
        .when(F.coalesce(oracle, F.lit("")) != "resolved", "oracle-unresolved").when(F.coalesce(review, F.lit("unreviewed")) == "unreviewed", "unreviewed")
        .when(F.coalesce(truncated, F.lit(False)), "truncated").when(F.size(F.coalesce(positives, F.array().cast("array<string>"))) == 0, "no-positive").otherwise("ready")
    )


def candidate_recall(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, recall, full): share of positives among the candidates, and of rows with all of them."""
    pos, cand = F.array_distinct("positives"), F.array_distinct("candidates")
    hit = F.size(F.array_intersect(pos, cand))
    return rows.where(F.size("positives") > 0).groupBy(*by).agg(
        (F.sum(hit) / F.sum(F.size(pos))).alias("recall"), F.avg((hit == F.size(pos)).cast("double")).alias("full")
    )


def collapse_groups(rows: DataFrame) -> DataFrame:
    """(grp, n, exact): a group is exact only if all its committed rows are."""
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.bool_and("exact").alias("exact"))


def funnel(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, total, exportable, labelled, with_candidates, reachable, committed, exact): nested counts of one pass."""
    steps = ["exportable", "labelled", "with_candidates", "reachable", "committed", "exact"]
    cond, out = F.lit(True), []
    for s in steps:
        cond = cond & F.coalesce(F.col(s), F.lit(False))
        out.append(F.count_if(cond).alias(s))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *out)


def reliability(rows: DataFrame, bins: int = 15) -> DataFrame:
    """(bin, n, mean_score, accuracy): equal-width bins of scores in [0, 1]."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("score") * bins).cast("int"))
    return rows.where("score BETWEEN 0 AND 1").groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("positive").cast("double")).alias("accuracy")
    )


def calibration_error(rows: DataFrame, bins: int = 15) -> DataFrame:
    """(n, ece, brier)."""
    r = reliability(rows, bins)
    total = rows.where("score BETWEEN 0 AND 1").agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("score") - F.col("positive").cast("double"), 2)).alias("brier"))
    gap = r.agg(F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("accuracy"))).alias("gap"))
    return total.join(gap).select("n", rate(F.col("gap"), F.col("n")).alias("ece"), "brier")


def risk_coverage(rows: DataFrame) -> DataFrame:
    """(threshold, committed, errors, coverage, risk): one row a distinct score, from cumulative counts."""
    per = rows.groupBy("score").agg(F.count(F.lit(1)).alias("c"), F.count_if(~F.col("positive")).alias("e"))
    # one row a distinct score goes through the window
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    every = rows.agg(F.count(F.lit(1)).alias("every"))
    return per.select(F.col("score").alias("threshold"), F.sum("c").over(w).alias("committed"), F.sum("e").over(w).alias("errors")).join(F.broadcast(every)).select(
        "threshold", "committed", "errors", (F.col("committed") / F.col("every")).alias("coverage"), (F.col("errors") / F.col("committed")).alias("risk")
    )


def certify_threshold(rows: DataFrame, target: float) -> DataFrame:
    """(threshold, groups, bound): the lowest threshold whose exact lower bound over whole groups reaches the target.

    A group counts as committed from its largest score on; it is exact while all
    its committed rows are, so it turns wrong at the largest score of its wrong rows.
    """
    per = rows.groupBy("grp").agg(F.max("score").alias("top"), F.max(F.when(~F.col("positive"), F.col("score"))).alias("wrong"))
    marks = per.select(F.col("top").alias("score"), F.lit(1).alias("g"), F.lit(0).alias("bad")).unionByName(
        per.where("wrong IS NOT NULL").select(F.col("wrong").alias("score"), F.lit(0).alias("g"), F.lit(1).alias("bad"))
    ).unionByName(rows.select("score", F.lit(0).alias("g"), F.lit(0).alias("bad"))).groupBy("score").agg(F.sum("g").alias("g"), F.sum("bad").alias("bad"))
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    cum = marks.select(F.col("score").alias("threshold"), F.sum("g").over(w).alias("groups"), F.sum("bad").over(w).alias("bad"))
    sure = cum.withColumn("bound", exact_lower_bound(F.col("groups") - F.col("bad"), F.col("groups"))).where(F.col("bound") >= target)
    return sure.orderBy("threshold").limit(1).select("threshold", "groups", "bound")


def isotonic_fit(rows: DataFrame, by: str) -> DataFrame:
    """(by, score, n, fitted): pool-adjacent-violators per model over its distinct scores; a model of one outcome only is not fitted (null)."""
    rows = rows.where("score IS NOT NULL")
    classes = rows.groupBy(by).agg(F.countDistinct("positive").alias("_classes"))
    per = rows.groupBy(by, "score").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("positive").cast("double")).alias("value"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score")
        pdf["fitted"] = isotonic(pdf["score"].tolist(), pdf["n"].tolist(), pdf["value"].tolist())
        return pdf[[by, "score", "n", "fitted"]]

    fitted = per.groupBy(by).applyInPandas(fit, f"`{by}` {dict(rows.dtypes)[by]}, score double, n long, fitted double")
    return fitted.join(classes, by).select(by, "score", "n", F.when(F.col("_classes") == 2, F.col("fitted")).alias("fitted"))


def nearest_rank(values: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, least, largest, one column a share): nearest-rank percentiles, not interpolated.

    By counts of distinct values, so no list of all values is built.
    """
    per = values.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    cum = per.select(by, "v", F.sum("c").over(w).alias("upto"), F.sum("c").over(Window.partitionBy(by)).alias("n"))
    return cum.groupBy(by).agg(
        F.max("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("largest"),
        *[F.min(F.when(F.col("upto") >= F.ceil(F.lit(p) * F.col("n")), F.col("v"))).alias(name) for name, p in shares.items()],
    )


def macro_accuracy(rows: DataFrame, family: str) -> DataFrame:
    """(families, macro): mean over families of their accuracy."""
    return rows.groupBy(family).agg(F.avg(F.col("positive").cast("double")).alias("a")).agg(F.count(F.lit(1)).alias("families"), F.avg("a").alias("macro"))


def set_scores(rows: DataFrame) -> DataFrame:
    """(case_id, precision, recall, f1) of expected and found sets; two empty sets score 1."""
    e, g = F.array_distinct("expected"), F.array_distinct("found")
    hit, ne, ng = F.size(F.array_intersect(e, g)), F.size(e), F.size(g)
    both = (ne == 0) & (ng == 0)
    p = F.when(both, 1.0).when(ng == 0, 0.0).otherwise(hit / ng)
    r = F.when(both, 1.0).when(ne == 0, 0.0).otherwise(hit / ne)
    return rows.select("case_id", p.alias("precision"), r.alias("recall")).withColumn(
        "f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    )


def audit_sample(rows: DataFrame, stratum: str, key: str, seed: str, share: float = 0.1, always: str | None = None) -> DataFrame:
    """Rows of a sample by hash rank, ceil(share n) of each stratum, and all rows where the column always holds."""
    w = Window.partitionBy(stratum)
    h = F.sha2(F.concat_ws("\0", F.lit(seed), F.col(key).cast("string")), 256)
    r = rows.withColumn("_h", h)
    r = r.withColumn("_i", F.row_number().over(w.orderBy("_h", key))).withColumn("_n", F.count(F.lit(1)).over(w))
    take = F.col("_i") <= F.ceil(F.col("_n") * share)
    return r.where(take | F.col(always) if always else take).drop("_h", "_i", "_n")


def leave_one_family_out(rows: DataFrame, family: str) -> DataFrame:
    """(family, n_test, n_train, train_accuracy): each family against all others, from totals instead of a join."""
    per = rows.groupBy(family).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("positive").cast("long")).alias("k"))
    total = per.agg(F.sum("n").alias("tn"), F.sum("k").alias("tk"))
    return per.join(F.broadcast(total)).select(
        F.col(family).alias("family"), F.col("n").alias("n_test"), (F.col("tn") - F.col("n")).alias("n_train"),
        rate(F.col("tk") - F.col("k"), F.col("tn") - F.col("n")).alias("train_accuracy"),
    )


def baseline_score(rank: Column, n: Column) -> Column:
    """Prior of a candidate's rank, damped by the number of candidates; null for other ranks."""
    prior = F.when(rank == 0, 0.9).when(rank == 1, 0.55).when(rank == 2, 0.3)
    return prior / (1 + F.log2(F.greatest(n, F.lit(1)).cast("double")))


def decide(response_ok: Column, threshold: Column, top: Column, n_candidates: Column, unknown: Column, verify: Column) -> Column:
    """commit, unknown or verify."""
    return (
        F.when(~F.coalesce(response_ok, F.lit(False)) | threshold.isNull(), "verify").when(top >= threshold, "commit")
        .when((n_candidates == 0) & (unknown > verify), "unknown").otherwise("verify")
    )


def exclusion_reason(positives: Column, negatives: Column, review: Column, oracle: Column) -> Column:
    """Why a label is not trusted, null if it is; the first rule that holds decides. Null lists are empty."""
    empty = F.array().cast("array<string>")
    p, n = F.coalesce(positives, empty), F.coalesce(negatives, empty)
    return (
        F.when(F.arrays_overlap(F.array_compact(p), F.array_compact(n)) | (F.coalesce(review, F.lit("")) == "conflict"), "label-conflict")
        .when(F.coalesce(review, F.lit("")) != "confirmed", "review-status-not-confirmed").when(F.coalesce(oracle, F.lit("")) != "resolved", "oracle-not-resolved")
        .when(F.size(p) == 0, "empty-positive-target-set")
    )


def eligible(reason: Column, candidate_miss: Column, status: Column, score: Column) -> Column:
    """Whether a scored candidate may fit a calibration: trusted label, no candidate missed, answered, a finite score in [0, 1]."""
    usable = score.isNotNull() & ~F.isnan(score) & score.between(0, 1)
    return F.coalesce(reason.isNull() & ~F.coalesce(candidate_miss, F.lit(False)) & (status == "ok") & usable, F.lit(False))


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same elements; null if either is null."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def groups_by_split(rows: DataFrame) -> DataFrame:
    """(split, n, groups, families) of (split, grp, family): distinct ones of each split."""
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("grp").alias("groups"), F.countDistinct("family").alias("families"))


def out_of_fold(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((groups, exact_groups), (family, commits, exact)) of committed rows (grp, family, exact).

    A group is exact only if all its rows are; it counts once in the pool, and once in each family that it touches.
    """
    exact = rows.groupBy("grp").agg(F.bool_and("exact").alias("exact"))
    pool = exact.agg(F.count(F.lit(1)).alias("groups"), F.count_if("exact").alias("exact_groups"))
    touched = rows.select("grp", "family").distinct().join(exact, "grp")
    return pool, touched.groupBy("family").agg(F.count(F.lit(1)).alias("commits"), F.count_if("exact").alias("exact"))


def family_gate(families: DataFrame, target: float, least_commits: int = 200) -> DataFrame:
    """(passes,): whether every family with least_commits or more commits reaches the target; smaller ones are ignored."""
    ok = (F.col("commits") < least_commits) | (F.col("exact") / F.col("commits") >= target)
    return families.agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("passes"))


def select_threshold(counts: DataFrame, target: float) -> DataFrame:
    """(kind, threshold, bound) of counts (threshold, bound, gate): the selected threshold, the lowest whose bound reaches the target and
    whose gate passes, if there is one; and always the best bound (the lowest threshold of equal ones), the strictest and the least strict."""
    row = lambda kind, df, by: df.agg(F.min_by(F.struct("threshold", "bound"), by).alias("r")).select(F.lit(kind).alias("kind"), "r.threshold", "r.bound")
    sure = counts.where((F.col("bound") >= target) & F.col("gate"))
    best = F.struct((-F.coalesce("bound", F.lit(-1.0))).alias("b"), "threshold")
    return (
        row("selected", sure, F.col("threshold")).unionByName(row("best", counts, best)).unionByName(row("strictest", counts, -F.col("threshold")))
        .unionByName(row("least-strict", counts, F.col("threshold"))).where("threshold IS NOT NULL")
    )


def slices(rows: DataFrame, keys: Column, dimension: DataFrame) -> DataFrame:
    """(slice, n, positives): rows of each slice that their keys name; slices of the dimension without rows have zeros."""
    n = rows.select(F.explode(F.array_distinct(keys)).alias("slice"), "positive").groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.count_if("positive").alias("positives"))
    return dimension.select("slice").distinct().join(n, "slice", "left").select("slice", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("positives", F.lit(0)).alias("positives"))
