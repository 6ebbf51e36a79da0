"""Maintenance: hash diffs, decisions, validity, queues, budgets, freshness, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.text import normalised_content, normalised_title
from gneiss.storage import Scratch


def hash_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, modified or removed by content hash."""
    o, n = old.select("path", F.col("hash").alias("h0"), F.lit(1).alias("a")), new.select("path", F.col("hash").alias("h1"), F.lit(1).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("h0").eqNullSafe(F.col("h1")), "modified")
    return o.join(n, "path", "full").select("path", change.alias("change")).where("change IS NOT NULL")


def upsert_decisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project_id, hash, times, commits, first_seq): one row a content hash; counts add up, new commits are appended in order.

    Both: (project_id, hash, commit, seq). The first commit stays the first.
    """
    both = old.select("project_id", "hash", "commit", "seq").unionByName(new.select("project_id", "hash", "commit", "seq"))
    per = both.groupBy("project_id", "hash", "commit").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("c"))
    return per.groupBy("project_id", "hash").agg(
        F.sum("c").alias("times"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "commit"))), lambda x: x["commit"]).alias("commits"), F.min("seq").alias("first_seq")
    )


def contradictions(decisions: DataFrame) -> DataFrame:
    """(anchor, title, contents): anchors with one title but differing contents, garbage left out; counts, not pairs."""
    d = decisions.where("coalesce(validity_status, '') <> 'garbage'").select(
        "anchor", normalised_title(F.col("title")).alias("title"), normalised_content(F.col("content")).alias("content")
    ).dropna()
    return d.groupBy("anchor", "title").agg(F.countDistinct("content").alias("contents")).where("contents > 1")


def validity(decisions: DataFrame, ranges: DataFrame, owners: DataFrame) -> DataFrame:
    """(decision_id, status): active while every anchored line still belongs to a commit of the decision; garbage stays garbage.

    ranges: (decision_id, path, start_line, end_line, commit); owners: (path, line, owner). Decisions without a range stay.
    """
    # the planner takes exploded lines for as small as what they come from and would broadcast them all through the driver
    w = ranges.join(owners.withColumnRenamed("path", "p").hint("merge"), (F.col("path") == F.col("p")) & (F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line")))
    alive = w.groupBy("decision_id").agg(F.bool_and(F.col("owner") == F.col("commit")).alias("alive"))
    return decisions.join(alive, "decision_id", "left").select(
        "decision_id",
        F.when(F.col("status") == "garbage", "garbage").when(F.col("alive").isNull(), F.col("status")).when(F.col("alive"), "active").otherwise("garbage").alias("status"),
    )


def queue_upsert(entries: DataFrame, key: str, seq: str) -> DataFrame:
    """Last entry of each key with the position of its first: column position."""
    w = Window.partitionBy(key)
    last = entries.withColumn("_i", F.row_number().over(w.orderBy(F.desc(seq)))).withColumn("position", F.min(seq).over(w))
    return last.where("_i = 1").drop("_i")


# How urgent a resolution class is; others, stale and contradicted ones are 0.
TIER_B_PRIORITY = {"likely": 1, "proven": 2}


def queue_order(queue: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(file, commit_sha, idx, position) of the queue: by most urgent resolution, signatures at that priority, file, commit, index.

    queue: (file, commit_sha, idx); resolutions: (file, cls, stale, verification, signature). A file without
    resolutions has priority 0 and no signature.
    """
    p = F.coalesce(*[F.when(F.col("cls") == c, F.lit(n)) for c, n in TIER_B_PRIORITY.items()], F.lit(0))
    p = F.when(F.coalesce("stale", F.lit(False)) | (F.coalesce("verification", F.lit("")) == "contradicted"), 0).otherwise(p)
    per = resolutions.groupBy("file", p.alias("p")).agg(F.array_join(F.array_sort(F.collect_set("signature")), "\0").alias("signatures"))
    least = per.groupBy("file").agg(F.min(F.struct("p", "signatures")).alias("m")).select("file", "m.p", "m.signatures")
    known = queue.join(least, "file", "left").select("file", "commit_sha", "idx", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("signatures", F.lit("")).alias("signatures"))
    return numbered(known, ["p", "signatures", "file", "commit_sha", "idx"]).select("file", "commit_sha", "idx", "position")


def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with position, from 1 on, in the total order of the keys, nulls first.

    Sorted by ranges of the keys, numbered within each range, and shifted by the sizes of the ranges before; no task
    holds more than a range, only one count a range goes to the driver's side of a broadcast.
    """
    order = [F.col(k).asc_nulls_first() for k in keys]
    ranged = Scratch(df.sparkSession, "ranges").keep(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # one row a range
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_i", within).join(F.broadcast(before), "_part").withColumn("position", (F.col("_i") + F.col("_before")).cast("int")).drop("_part", "_i", "_before")


def evict(queue: DataFrame, failures: DataFrame, most: int = 3) -> DataFrame:
    """Queue without entries that failed at least most times since they last succeeded.

    failures: (key, seq, ok).
    """
    last_ok = failures.groupBy("key").agg(F.max(F.when(F.col("ok"), F.col("seq"))).alias("ok_at"))
    bad = failures.where("NOT ok").join(last_ok, "key").where(F.col("seq") > F.coalesce("ok_at", F.lit(-1))).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return queue.join(bad.where(F.col("n") >= most).select("key"), "key", "left_anti")


def within_budget(calls: DataFrame, most_calls: int = 50, most_tokens: int = 100_000) -> DataFrame:
    """calls with (day, nth, spent, allowed): per key and UTC day, in order of ts and id, until a cap is reached."""
    day = F.to_date("ts")
    w = Window.partitionBy("key", "day").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    c = calls.withColumn("day", day).withColumn("nth", F.count(F.lit(1)).over(w)).withColumn("spent", F.sum("tokens").over(w))
    return c.withColumn("allowed", (F.col("nth") <= most_calls) & (F.col("spent") <= most_tokens))


def zero_progress(batches: DataFrame, most: int = 3) -> DataFrame:
    """(key, seq, streak, escalate): runs of batches without progress; batches without an attempt keep the streak.

    batches: (key, seq, attempted, progressed). Progress ends a streak.
    """
    tried = batches.where("attempted")
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(F.col("progressed").cast("int")).over(w)
    g = tried.withColumn("g", run)
    streak = F.sum((~F.col("progressed")).cast("int")).over(Window.partitionBy("key", "g").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return g.select("key", "seq", streak.alias("streak")).withColumn("escalate", (F.col("streak") > 0) & (F.col("streak") % most == 0))


def triggered(changes: DataFrame, most: int = 512_000) -> DataFrame:
    """(key, seq, total, trigger): running bytes of each key (null counts as 0) and where they first pass the limit."""
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    t = changes.withColumn("bytes", F.coalesce("bytes", F.lit(0))).withColumn("total", F.sum("bytes").over(w))
    return t.select("key", "seq", "total", ((F.col("total") >= most) & (F.col("total") - F.col("bytes") < most)).alias("trigger"))


def budget_prefix(parts: DataFrame, most: int = 8000, each: int = 500, least_confidence: float = 0.0) -> DataFrame:
    """(grp, id, size, kept): lines "- [type] title: text", text cut to each characters, by confidence, then title, then id, up to the first that overflows.

    parts: (grp, id, node_type, title, confidence, text); a null confidence passes any least one and sorts as 0. What
    comes after the first overflow is dropped too. As a line has six characters or more, only the first most / 6 + 1
    of a group can be kept, so only these are summed up; a group of any size is cut to them before its window.
    """
    p = parts.where(F.coalesce("confidence", F.lit(1.0)) >= least_confidence)
    size = 6 + F.length(F.coalesce("node_type", F.lit("node"))) + F.length(F.coalesce("title", F.lit(""))) + F.least(F.length(F.coalesce("text", F.lit(""))), F.lit(each))
    order = [F.coalesce("confidence", F.lit(0.0)).desc(), F.col("title").asc_nulls_first(), F.col("id")]
    p = p.withColumn("size", size)
    w = Window.partitionBy("grp").orderBy(*order)
    first = p.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most // 6 + 1)
    upto = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = first.withColumn("_upto", upto).where(F.col("_upto") <= most).select(F.col("grp").alias("_g"), F.col("id").alias("_id"), F.lit(True).alias("kept"))
    return p.join(kept, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("id") == F.col("_id")), "left").select("grp", "id", "size", F.coalesce("kept", F.lit(False)).alias("kept"))


def compress(nodes: DataFrame) -> DataFrame:
    """Best row of each title and first 200 characters, by confidence, then id."""
    w = Window.partitionBy("grp", "title", F.substring("text", 1, 200)).orderBy(F.desc("confidence"), "id")
    return nodes.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def freshness(ingested: Column, head: Column) -> Column:
    """fresh, stale, or unknown if either is missing."""
    return F.when(ingested.isNull() | head.isNull(), "unknown").when(ingested == head, "fresh").otherwise("stale")


def status(**counts: DataFrame) -> DataFrame:
    """(metric, value): one row a table of counts."""
    out = None
    for name, df in counts.items():
        row = df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")
        out = row if out is None else out.unionAll(row)
    return out


def health(metrics: DataFrame) -> DataFrame:
    """metrics (metric, good, total) with (rate, verdict): no total is a rate of 1; coverage below half fails, resolution is a note."""
    r = F.when(F.col("total") == 0, 1.0).otherwise(F.col("good") / F.col("total"))
    low = F.col("rate") < 0.5
    return metrics.withColumn("rate", r).withColumn("verdict", F.when(low & (F.col("metric") == "coverage"), "fail").when(low, "note").otherwise("ok"))


def publishable(changed: DataFrame, decisions: DataFrame, synced: DataFrame) -> DataFrame:
    """Decisions of changed nodes whose hash is not synced yet."""
    return decisions.join(changed.select("node_key").distinct(), "node_key", "left_semi").join(synced.select("hash").distinct(), "hash", "left_anti")


def hotspots(changes: DataFrame, domain: Column, scope: str, order: str, k: int = 5, commits: int = 100) -> DataFrame:
    """(scope, domain, n): the k domains with most changes in the last commits of each scope; ties by name, no domain left out of the count.

    order: column whose last distinct values are the last commits.
    """
    last = changes.select(scope, order).dropna().distinct()
    last = last.withColumn("_i", F.row_number().over(Window.partitionBy(scope).orderBy(F.desc(order)))).where(F.col("_i") <= commits).drop("_i")
    n = changes.join(last, [scope, order], "left_semi").where(domain.isNotNull()).groupBy(scope, domain.alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(scope).orderBy(F.desc("n"), "domain")
    return n.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= k).select(scope, "domain", "n")
