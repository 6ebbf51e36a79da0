"""Resolution records, lookups and pruning: the store's read and write operations over whole tables.

Resolution heads: (project_id, site_key, file_path, line, col, source_hash, cls, selected, confidence, stale, signature,
verification, verified); candidates: (project_id, site_key, ordinal, target); dependencies: (project_id, site_key, path, hash).

Defined cases: null keys belong to no record; a head without candidates or dependencies has empty lists; repeated rows
count once where a key must be unique and are reported by the validators; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = ["proven", "likely", "ambiguous", "unresolved", "external", "unsupported"]


def lookup(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose column is among the wanted values: point and IN-list reads as one semi-join; null is never wanted."""
    return rows.join(wanted.select(F.col(wanted.columns[0]).alias(column)).dropna().distinct(), column, "left_semi")


def lookup_any(rows: DataFrame, columns: list[str], wanted: DataFrame) -> DataFrame:
    """Rows one of whose columns is among the wanted values, each once."""
    keys = wanted.select(F.col(wanted.columns[0]).alias("_w")).dropna().distinct()
    named = rows.withColumn("_k", F.array_distinct(F.array_compact(F.array(*columns)))).withColumn("_id", F.struct(*rows.columns))
    hit = named.select("_id", F.explode("_k").alias("_w")).join(keys, "_w", "left_semi").select("_id").distinct()
    return hit.select("_id.*")


def first_pattern(patterns: Column) -> Column:
    """First element of a JSON array of strings; null if it is malformed, no array, or empty."""
    return F.get(F.from_json(patterns, "array<string>"), F.lit(0))


def nodes_for_files(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """(node_key): nodes one of whose path patterns (a JSON array) is a changed file; malformed patterns match nothing."""
    paths = nodes.select("node_key", F.explode(F.from_json("patterns", "array<string>")).alias("path"))
    return paths.join(changed.select("path").distinct(), "path", "left_semi").select("node_key").distinct()


def stale_nodes(nodes: DataFrame, active: DataFrame) -> DataFrame:
    """(node_key): nodes whose patterns are missing, malformed or name no active file."""
    paths = nodes.select("node_key", F.explode(F.from_json("patterns", "array<string>")).alias("path"))
    alive = paths.join(active.select("path").distinct(), "path", "left_semi").select("node_key").distinct()
    return nodes.select("node_key").join(alive, "node_key", "left_anti").distinct()


def prune(files: DataFrame, nodes: DataFrame, links: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(files, nodes, links, (pruned_files, pruned_nodes)) without what the active files do not hold; links of pruned nodes go too."""
    gone = stale_nodes(nodes, active)
    kept_files = files.join(active.select("path").distinct(), "path", "left_semi")
    kept_nodes = nodes.join(gone, "node_key", "left_anti")
    keys = kept_nodes.select("node_key")
    kept_links = links.join(keys, links.src == keys.node_key, "left_semi").join(keys, F.col("dst") == keys.node_key, "left_semi")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = n(files.join(active.select("path").distinct(), "path", "left_anti"), "pruned_files").crossJoin(n(gone, "pruned_nodes"))
    return kept_files, kept_nodes, kept_links, counts


def read_records(heads: DataFrame, candidates: DataFrame, dependencies: DataFrame) -> DataFrame:
    """heads with candidates (targets by ordinal) and dependencies (path and hash by path), folded by key."""
    key = ["project_id", "site_key"]
    c = candidates.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "target"))), lambda x: x["target"]).alias("candidates"))
    d = dependencies.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("path", "hash"))).alias("dependencies"))
    out = heads.join(c, key, "left").join(d, key, "left")
    return out.withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>"))).withColumn(
        "dependencies", F.coalesce("dependencies", F.array().cast("array<struct<path:string,hash:string>>"))
    )


def replace_for_files(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """old without the records of the files, and new; new records of other files are left out."""
    f = files.select("project_id", "file_path").distinct()
    return old.join(f, ["project_id", "file_path"], "left_anti").unionByName(new.join(f, ["project_id", "file_path"], "left_semi"))


def normal_dependencies(heads: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(project_id, site_key, path, hash, conflict): the caller's own file is added; a path with two hashes is a conflict (hash null)."""
    own = heads.select("project_id", "site_key", F.col("file_path").alias("path"), F.col("source_hash").alias("hash"))
    every = own.unionByName(dependencies.select("project_id", "site_key", "path", "hash")).dropna(subset=["site_key", "path"])
    g = every.groupBy("project_id", "site_key", "path").agg(F.min("hash").alias("a"), F.max("hash").alias("b"))
    conflict = ~F.col("a").eqNullSafe(F.col("b"))
    return g.select("project_id", "site_key", "path", F.when(~conflict, F.col("a")).alias("hash"), conflict.alias("conflict"))


def violations(heads: DataFrame, candidates: DataFrame) -> DataFrame:
    """(project_id, site_key, reason): records that a write would reject, by the first reason.

    duplicate-key; duplicate-candidate (an ordinal or a target twice); unknown-class; selection (a target without a
    proven, likely or matching verified result, or one of these without a target); confidence (outside [0, 1], or of
    another class than likely); verification (verified without a verified target, or one without the status).
    """
    key = ["project_id", "site_key"]
    twice = heads.groupBy(*key).agg((F.count(F.lit(1)) > 1).alias("twice"))
    c = candidates.groupBy(*key).agg(((F.count(F.lit(1)) != F.countDistinct("ordinal")) | (F.count(F.lit(1)) != F.countDistinct("target"))).alias("bad_candidates"))
    shown = F.col("cls").isin("proven", "likely")
    verified = (F.coalesce("verification", F.lit("")) == "verified") & F.coalesce(F.col("verified") == F.col("selected"), F.lit(False))
    wrong_confidence = F.col("confidence").isNotNull() & (~F.col("confidence").between(0, 1) | (F.col("cls") != "likely"))
    has_result = F.coalesce(F.col("verification").isin("verified", "contradicted"), F.lit(False))
    reason = (
        F.when(F.col("twice"), "duplicate-key").when(F.coalesce("bad_candidates", F.lit(False)), "duplicate-candidate")
        .when(~F.coalesce(F.col("cls").isin(CLASSES), F.lit(False)), "unknown-class")
        .when((F.col("selected").isNotNull() & ~shown & ~verified) | (F.col("selected").isNull() & shown), "selection")
        .when(F.coalesce(wrong_confidence, F.lit(False)), "confidence").when(has_result != F.col("verified").isNotNull(), "verification")
    )
    return heads.join(twice, key).join(c, key, "left").select(*key, reason.alias("reason")).where("reason IS NOT NULL").distinct()


def current_resolutions(heads: DataFrame, sites: DataFrame) -> DataFrame:
    """heads that still stand for a live call site: its position is unique on both sides, same file and source hash, not stale, with a signature.

    sites: (project_id, file_path, line, col, source_hash).
    """
    at = ["project_id", "file_path", "line", "col"]
    one = lambda df: df.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"), F.first("source_hash").alias("_live")).where("_n = 1").drop("_n")
    unique = heads.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    kept = heads.join(unique, at, "left_semi").join(one(sites), at)
    fresh = (F.col("source_hash") == F.col("_live")) & ~F.coalesce("stale", F.lit(False)) & (F.trim(F.coalesce("signature", F.lit(""))) != "")
    return kept.where(fresh).drop("_live")


def covered_files(heads: DataFrame, sites: DataFrame) -> DataFrame:
    """(project_id, file_path, complete): whether call sites and resolutions of a file are in a bijection on their positions."""
    at = ["project_id", "file_path", "line", "col"]
    count = lambda df, name: df.groupBy(*at).agg(F.count(F.lit(1)).alias(name))
    j = count(heads, "h").join(count(sites, "s"), at, "full")
    ok = (F.coalesce("h", F.lit(0)) == 1) & (F.coalesce("s", F.lit(0)) == 1)
    return j.groupBy("project_id", "file_path").agg(F.bool_and(ok).alias("complete"))


def forward_requests(resolutions: DataFrame, certified: DataFrame, quarantined: DataFrame, bucket: Column, rate: float) -> DataFrame:
    """(site_key, cls, mode, idx) of the call sites to forward, in the order of their priority and idx.

    A certified, proven, not quarantined site is skipped, unless its bucket is below the rate: then mode is canary. A
    quarantined rule counts as ambiguous. resolutions: (site_key, cls, signature, idx).
    """
    c = certified.select("signature").dropna().distinct().withColumn("_c", F.lit(True))
    q = quarantined.select("signature").dropna().distinct().withColumn("_q", F.lit(True))
    r = resolutions.withColumn("_bucket", bucket).join(c, "signature", "left").join(q, "signature", "left")
    is_quarantined = F.coalesce("_q", F.lit(False))
    safe = F.coalesce("_c", F.lit(False)) & (F.col("cls") == "proven") & ~is_quarantined
    return r.where(~safe | (F.col("_bucket") < rate)).select(
        "site_key", F.when(is_quarantined, "ambiguous").otherwise(F.col("cls")).alias("cls"), F.when(safe, "canary").otherwise("verify").alias("mode"), "idx"
    )


def latest_by(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of the largest order of each key (latest observation or audit)."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def clear_quarantine(active: DataFrame, audits: DataFrame, requests: DataFrame) -> DataFrame:
    """(signature, outcome): what clearing the quarantine of each requested rule gives.

    active: (signature, since, config_hash); audits: (signature, id); requests: (signature, config_hash, evidence_at).
    already-cleared without an active row but with an audit, not-found without either; rejected if the old
    configuration is unknown or the same, or the evidence is not newer than the quarantine; else cleared.
    """
    past = audits.groupBy("signature").agg(F.max("id").alias("last"))
    a = active.select("signature", "since", F.col("config_hash").alias("old"))
    j = requests.join(a, "signature", "left").join(past, "signature", "left")
    outcome = (
        F.when(F.col("since").isNull(), F.when(F.col("last").isNotNull(), "already-cleared").otherwise("not-found"))
        .when(F.col("old").isNull() | F.col("old").eqNullSafe(F.col("config_hash")) | F.coalesce(F.col("evidence_at") <= F.col("since"), F.lit(True)), "rejected").otherwise("cleared")
    )
    return j.select("signature", outcome.alias("outcome"))


def stats_merge(old: DataFrame, reparsed: DataFrame, retired: DataFrame) -> DataFrame:
    """Per-file rows: those of reparsed files replaced, those of retired files dropped (a file that is both stays)."""
    out = old.join(reparsed.select("path").unionByName(retired.select("path")).distinct(), "path", "left_anti")
    return out.unionByName(reparsed)


def key_in_files(keys: DataFrame, files: DataFrame) -> DataFrame:
    """(node_key): keys that are a file or lie in one, trying every # as the end of the path, as paths may contain it."""
    parts = F.split("node_key", "#")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "#"))
    return keys.select("node_key", F.explode(prefixes).alias("path")).join(files.select("path").distinct(), "path", "left_semi").select("node_key").distinct()


def lexical_parents(symbols: DataFrame) -> DataFrame:
    """(symbol, parent): the smallest span of the same file that strictly encloses a symbol's; the larger key of equal ones loses; null if none.

    symbols: (path, symbol, start_line, end_line).
    """
    outer = symbols.select(F.col("path").alias("p"), F.col("symbol").alias("o"), F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    encloses = (F.col("s") <= F.col("start_line")) & (F.col("e") >= F.col("end_line")) & ((F.col("e") - F.col("s")) > (F.col("end_line") - F.col("start_line")))
    hit = symbols.join(outer, (F.col("path") == F.col("p")) & encloses)
    best = hit.groupBy("path", "symbol").agg(F.min(F.struct((F.col("e") - F.col("s")).alias("n"), "o")).alias("b"))
    return symbols.select("path", "symbol").join(best, ["path", "symbol"], "left").select("path", "symbol", F.col("b.o").alias("parent"))
