"""Call resolution: candidates, ranking, proofs, projection, invalidation, verification, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROVEN, LIKELY = "proven", "likely"
# Weights of candidate evidence.
WEIGHTS = {"receiver_type": 100, "peer_members": 20, "arity": 10, "same_directory": 1}
CERTIFIED_GROUPS, CERTIFIED_BOUND = 299, 0.99


def name_candidates(call_sites: DataFrame, symbols: DataFrame, calls: DataFrame, imports: DataFrame, limit: int = 25) -> DataFrame:
    """(site_id, target_key, ordinal, truncated): symbols of the called name in other files.

    Order: what the file is known to call, then symbols of files that it imports, then the rest, each by key; the
    limit is the reference bound of a candidate list, truncated says that there are more.
    call_sites: (site_id, file_path, callee); symbols: (symbol_key, name, path); calls: (file_path, target_key);
    imports: (file_path, imported).
    """
    # sites of one file that call one name have one list, so pairs of sites and symbols are never formed
    s = symbols.where("name IS NOT NULL AND path IS NOT NULL").select("symbol_key", "name", "path", F.row_number().over(Window.partitionBy("name", "path").orderBy("symbol_key")).alias("i"))
    lists = call_sites.where("callee IS NOT NULL AND file_path IS NOT NULL").select("file_path", F.col("callee").alias("name")).distinct()
    row = lambda df, n: df.select("file_path", "name", "path", "symbol_key", "i", F.lit(n).alias("evidence"))
    called = calls.select("file_path", F.col("target_key").alias("symbol_key")).distinct().join(s, "symbol_key").where("path <> file_path").join(lists, ["file_path", "name"], "left_semi")
    called = called.withColumn("o", F.row_number().over(Window.partitionBy("file_path", "name").orderBy("symbol_key"))).where(F.col("o") <= limit)
    # fewer than limit of a file's symbols are called (else no others are wanted), so its first ones leave enough
    first = s.where(F.col("i") <= limit)
    near = lists.join(imports.select("file_path", F.col("imported").alias("path")).distinct(), "file_path").join(first, ["name", "path"]).where("path <> file_path")
    # of the first 2 * limit of a name at most limit are of the file itself, and those called or imported take places of the list
    head = first.withColumn("o", F.row_number().over(Window.partitionBy("name").orderBy("symbol_key", "path", "i"))).where(F.col("o") <= 2 * limit)
    rest = lists.join(head, "name").where("path <> file_path")
    pool = row(called, 0).unionAll(row(near, 1)).unionAll(row(rest, 2)).groupBy("file_path", "name", "path", "symbol_key", "i").agg(F.min("evidence").alias("evidence"))
    pool = pool.withColumn("o", F.row_number().over(Window.partitionBy("file_path", "name").orderBy("evidence", "symbol_key"))).where(F.col("o") <= limit)
    pool = pool.groupBy("file_path", "name").agg(F.array_sort(F.collect_list(F.struct("evidence", "symbol_key"))).alias("targets"))
    own = s.groupBy("name", F.col("path").alias("file_path")).agg(F.count(F.lit(1)).alias("own"))
    size = own.groupBy("name").agg(F.sum("own").alias("size"))
    lists = pool.join(own, ["file_path", "name"], "left").join(size, "name").select("file_path", F.col("name").alias("callee"), "targets", (F.col("size") - F.coalesce("own", F.lit(0))).alias("n"))
    # a site given in several rows has the candidates of all of them
    rows = call_sites.select("site_id", "file_path", "callee", F.count(F.lit(1)).over(Window.partitionBy("site_id")).alias("rows")).join(lists, ["file_path", "callee"])
    once = rows.where("rows = 1").select("site_id", F.posexplode("targets").alias("ordinal", "c"), (F.col("n") > limit).alias("truncated"))
    several = rows.where("rows > 1").withColumn("n", F.sum("n").over(Window.partitionBy("site_id"))).select("site_id", F.explode("targets").alias("c"), (F.col("n") > limit).alias("truncated"))
    w = Window.partitionBy("site_id").orderBy("c.evidence", "c.symbol_key")
    several = several.withColumn("ordinal", F.row_number().over(w) - 1).where(F.col("ordinal") < limit).select("site_id", "ordinal", "c", "truncated")
    return once.unionAll(several).select("site_id", F.col("c.symbol_key").alias("target_key"), "ordinal", "truncated")


def rank_candidates(c: DataFrame) -> DataFrame:
    """Candidates with (points, ordinal): sum of evidence weights, then path, start, static first, key."""
    points = sum((F.when(F.col(k), w).otherwise(0) for k, w in WEIGHTS.items()), F.lit(0))
    w = Window.partitionBy("site_id").orderBy(F.desc("points"), "path", "start_line", F.desc("is_static"), "target_key")
    return c.withColumn("points", points).withColumn("ordinal", F.row_number().over(w) - 1)


def narrow(c: DataFrame, stages: list[str]) -> DataFrame:
    """Filter candidates stage by stage; a stage counts only if it leaves fewer candidates, but some."""
    w = Window.partitionBy("site_id")
    for s in stages:
        n, all_n = F.count_if(F.coalesce(F.col(s), F.lit(False))).over(w), F.count(F.lit(1)).over(w)
        c = c.withColumn("_n", n).withColumn("_all", all_n).where(
            (F.col("_n") == 0) | (F.col("_n") == F.col("_all")) | F.coalesce(F.col(s), F.lit(False))
        ).drop("_n", "_all")
    return c


def decision(n: Column, supported: Column, calibrated: Column, truncated: Column, top: Column, second: Column, threshold: float) -> Column:
    """Outcome of a site; the first rule that holds decides."""
    return (
        F.when(n == 0, "no-candidates").when(~supported, "unsupported").when(~calibrated, "uncalibrated").when(truncated, "truncated")
        .when((top == second) | (top < threshold), "ambiguous").otherwise(LIKELY)
    )


def trusted(cls: Column, selected: Column, stale: Column, verification: Column, verified: Column) -> Column:
    """Whether a resolution may be shown as resolved: not stale, not contradicted, and proven or verified for the selected target."""
    status = F.coalesce(verification, F.lit(""))
    sure = (cls == PROVEN) | ((status == "verified") & selected.isNotNull() & F.coalesce(verified == selected, F.lit(False)))
    return F.coalesce(~F.coalesce(stale, F.lit(False)) & (status != "contradicted") & sure, F.lit(False))


def evidence_label(is_trusted: Column, verification: Column) -> Column:
    """tier-b-verified or static-proof of a trusted resolution, else null."""
    return F.when(is_trusted, F.when(verification == "verified", "tier-b-verified").otherwise("static-proof"))


def masked(cls: Column, confidence: Column, stale: Column) -> tuple[Column, Column]:
    """Class (unknown if stale) and confidence (only of likely ones)."""
    c = F.when(F.coalesce(stale, F.lit(False)), "unknown").otherwise(cls)
    return c, F.when(c == LIKELY, confidence)


def alternatives(candidates: Column, selected: Column, cls: Column, stale: Column) -> tuple[Column, Column]:
    """(alternatives, ambiguous) of candidates (ordinal, target): two others of a likely resolution, three of an ambiguous one; stale ones have none."""
    ordered = F.array_sort(candidates)
    targets = lambda c, n: F.transform(F.slice(c, 1, n), lambda x: x["target"])
    fresh, none = ~F.coalesce(stale, F.lit(False)), F.slice(F.transform(ordered, lambda x: x["target"]), 1, 0)
    others = F.filter(ordered, lambda x: ~x["target"].eqNullSafe(selected))
    return F.when(fresh & (cls == LIKELY), targets(others, 2)).otherwise(none), F.when(fresh & (cls == "ambiguous"), targets(ordered, 3)).otherwise(none)


def projection(resolutions: DataFrame, quarantines: DataFrame, nodes: DataFrame) -> DataFrame:
    """(caller, target): distinct calls of current resolutions; no stale ones, no self calls, both ends known.

    A quarantined rule is left out unless the site was verified or contradicted, so this is no plain anti-join.
    """
    q = quarantines.select(F.col("rule").alias("q")).distinct()
    keys = nodes.select("node_key")
    r = resolutions.where(~F.coalesce("stale", F.lit(False))).join(q, F.col("rule") == F.col("q"), "left")
    kept = r.where(F.col("q").isNull() | F.col("verification").isin("verified", "contradicted")).where("target <> caller")
    return (
        kept.join(keys, F.col("caller") == F.col("node_key"), "left_semi").join(keys, F.col("target") == F.col("node_key"), "left_semi")
        .select("caller", "target").distinct()
    )


def invalidate(resolutions: DataFrame, dependencies: DataFrame, changed: DataFrame) -> DataFrame:
    """resolutions with stale set where a dependency's file changed to another hash (or none)."""
    c = changed.select(F.col("path").alias("p"), F.col("hash").alias("new_hash"))
    hit = dependencies.join(c, F.col("path") == F.col("p")).where(~F.col("hash").eqNullSafe(F.col("new_hash"))).select(F.col("site_id").alias("hit")).distinct()
    return resolutions.join(hit, F.col("site_id") == F.col("hit"), "left").withColumn("stale", F.coalesce("stale", F.lit(False)) | F.col("hit").isNotNull()).drop("hit")


def apply_verification(resolutions: DataFrame, results: DataFrame) -> DataFrame:
    """(site_id, verification, selected, quarantine): unique results verify or contradict; a contradicted proof quarantines its rule.

    results: (site_id, unique, target); a result that is not unique is an observation only. The last result of a site counts.
    """
    w = Window.partitionBy("site_id").orderBy(F.desc("seq"))
    last = results.where("is_unique AND found IS NOT NULL").withColumn("i", F.row_number().over(w)).where("i = 1").select("site_id", "found")
    r = resolutions.join(last, "site_id", "left")
    same = F.col("found").eqNullSafe(F.col("target"))
    return r.select(
        "site_id",
        F.when(F.col("found").isNull(), F.col("verification")).when((F.col("cls") == PROVEN) & ~same, "contradicted").otherwise("verified").alias("verification"),
        F.coalesce("found", "target").alias("selected"),
        F.when(F.col("found").isNotNull() & (F.col("cls") == PROVEN) & ~same, F.col("rule")).alias("quarantine"),
    )


def site_counters(sites: DataFrame) -> DataFrame:
    """(file_path, total, proven, likely, ambiguous, unresolved, external, unsupported, applicable)."""
    names = ["proven", "likely", "ambiguous", "unresolved", "external", "unsupported"]
    n = sites.groupBy("file_path").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("bucket") == x).alias(x) for x in names])
    return n.withColumn("applicable", F.col("total") - F.col("external") - F.col("unsupported"))


def certification(units: DataFrame) -> DataFrame:
    """(rule, n_groups, wrong, bound, certified): no contradiction, enough groups, bound reached."""
    from gneiss.functions.stats import exact_lower_bound

    g = units.groupBy("rule", "grp").agg(F.bool_and("exact").alias("ok"))
    s = g.groupBy("rule").agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(~F.col("ok")).alias("wrong"))
    s = s.withColumn("bound", exact_lower_bound(F.col("n_groups") - F.col("wrong"), F.col("n_groups")))
    return s.withColumn("certified", (F.col("wrong") == 0) & (F.col("n_groups") >= CERTIFIED_GROUPS) & (F.col("bound") >= CERTIFIED_BOUND))


def named_import_proof(sites: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """(site_id, target, reason): prove a bare call through one named import of one export, or abstain with a reason.

    sites: (site_id, file_path, callee); imports: (file_path, local, original, module); exports: (module, name, kind).
    """
    i = imports.groupBy("file_path", "local").agg(F.count(F.lit(1)).alias("n_i"), F.first("original").alias("original"), F.first("module").alias("module"))
    e = exports.groupBy("module", "name").agg(F.count(F.lit(1)).alias("n_e"), F.max("kind").alias("kind"))
    owners = exports.where("kind = 'function'").groupBy("name").agg(F.count(F.lit(1)).alias("n_o"))
    j = (
        sites.join(i.withColumnRenamed("file_path", "f"), (F.col("file_path") == F.col("f")) & (F.col("callee") == F.col("local")), "left")
        .join(e.withColumnRenamed("module", "m").withColumnRenamed("name", "en"), (F.col("module") == F.col("m")) & (F.col("original") == F.col("en")), "left")
        .join(owners.withColumnRenamed("name", "on"), F.col("original") == F.col("on"), "left")
    )
    reason = (
        F.when(F.coalesce("n_i", F.lit(0)) != 1, "unresolved-call-binding").when(F.coalesce("n_e", F.lit(0)) != 1, "unresolved-call-binding")
        .when((F.col("kind") != "function") | (F.coalesce("n_o", F.lit(0)) != 1), "no-unique-owner-candidate")
    )
    return j.select("site_id", F.when(reason.isNull(), F.concat("module", F.lit("#"), "original")).alias("target"), reason.alias("reason"))


def reexport_trace(requests: DataFrame, direct: DataFrame, forwards: DataFrame, depth: int = 16) -> DataFrame:
    """(site_id, module, name, hops): follow re-exports from (site_id, module, name) to the one direct export.

    direct: (module, name); forwards: (module, name, to_module, to_name). More than one way at a level, a cycle or
    more than depth hops give null.
    """
    from gneiss.storage import Scratch

    scratch = Scratch(requests.sparkSession, "reexports")
    front = requests.select("site_id", "module", "name", F.array(F.concat_ws("#", "module", "name")).alias("seen"))
    done = None
    d = direct.distinct().select("module", "name", F.lit(1).alias("here"))
    f = forwards.distinct()
    for h in range(depth + 1):
        at = scratch.keep(front.join(d, ["module", "name"], "left").join(f, ["module", "name"], "left"))
        w = Window.partitionBy("site_id")
        ways = F.coalesce(F.max("here").over(w), F.lit(0)) + F.count("to_module").over(w)
        at = at.withColumn("ways", ways)
        found = at.where("here = 1 AND ways = 1").select("site_id", "module", "name", F.lit(h).alias("hops"))
        done = found if done is None else done.unionByName(found)
        nxt = at.where("here IS NULL AND ways = 1").select(
            "site_id", F.col("to_module").alias("module"), F.col("to_name").alias("name"), "seen", F.concat_ws("#", "to_module", "to_name").alias("key")
        )
        front = nxt.where(~F.array_contains("seen", F.col("key"))).select("site_id", "module", "name", F.concat("seen", F.array("key")).alias("seen"))
        if front.isEmpty():
            break
    return requests.select("site_id").distinct().join(done, "site_id", "left")


def receiver_ladder(sites: DataFrame) -> DataFrame:
    """(site_id, target, step): the first step of the member ladder that gives a target."""
    steps = ["own_class", "import_receiver", "declared_receiver", "same_file"]
    return sites.select(
        "site_id", F.coalesce(*[F.col(s) for s in steps]).alias("target"), F.coalesce(*[F.when(F.col(s).isNotNull(), F.lit(s)) for s in steps]).alias("step")
    )


def inherited_member(requests: DataFrame, members: DataFrame, extends: DataFrame, depth: int = 16) -> DataFrame:
    """(site_id, cls, hops): the first class up the extends chain with exactly one such instance member; null if none.

    requests: (site_id, cls, member); members: (cls, member, is_static); extends: (cls, base), one base a class.
    """
    from gneiss.storage import Scratch

    scratch = Scratch(requests.sparkSession, "climb")
    m = members.groupBy("cls", "member").agg(F.count(F.lit(1)).alias("n"), F.max("is_static").alias("any_static"))
    up = extends.groupBy("cls").agg(F.min("base").alias("base"), F.count(F.lit(1)).alias("nb")).where("nb = 1").select("cls", "base")
    front = requests.select("site_id", "cls", "member", F.array("cls").alias("seen"))
    done = None
    for h in range(depth + 1):
        at = scratch.keep(front.join(m, ["cls", "member"], "left"))
        found = at.where("n = 1 AND NOT any_static").select("site_id", "cls", F.lit(h).alias("hops"))
        done = found if done is None else done.unionByName(found)
        front = at.where("n IS NULL").join(up, "cls").where(~F.array_contains("seen", F.col("base"))).select(
            "site_id", F.col("base").alias("cls"), "member", F.concat("seen", F.array("base")).alias("seen")
        )
        if front.isEmpty():
            break
    return requests.select("site_id").distinct().join(done, "site_id", "left")
