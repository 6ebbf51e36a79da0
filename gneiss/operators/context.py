"""Context of nodes and the whole blast radius: unions of layers, each with what the layers before have not shown.

Nodes and links as in graph.py. Every operator takes a table of targets (node_key), so that one job answers all.

Defined cases: unknown targets have no rows; repeated links count once; a target without neighbours has only the hint row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators.graph import LEXICAL, STRUCTURAL


def relations(nodes: DataFrame, links: DataFrame, targets: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(target, direction, name, link_type, summaries): non-structural relations; calls carry the sorted labels of their resolutions.

    resolutions: (caller, callee, label), current ones; links of other types have null summaries.
    """
    want = targets.select(F.col("node_key").alias("target")).distinct()
    names = nodes.select(F.col("node_key").alias("other"), "name")
    kept = links.where(~F.col("link_type").isin(STRUCTURAL))
    into = kept.select(F.col("dst").alias("target"), F.col("src").alias("other"), "link_type", F.lit("incoming").alias("direction"))
    out = kept.select(F.col("src").alias("target"), F.col("dst").alias("other"), "link_type", F.lit("outgoing").alias("direction"))
    both = into.unionByName(out).join(want, "target", "left_semi").join(names, "other").distinct()
    r = resolutions.groupBy("caller", "callee").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    caller = F.when(F.col("direction") == "incoming", F.col("other")).otherwise(F.col("target"))
    callee = F.when(F.col("direction") == "incoming", F.col("target")).otherwise(F.col("other"))
    keyed = both.withColumn("caller", caller).withColumn("callee", callee).join(r, ["caller", "callee"], "left")
    labels = F.when(F.col("link_type") == "calls", F.coalesce("labels", F.array().cast("array<string>")))
    return keyed.select("target", "direction", "name", "link_type", labels.alias("summaries"))


def coverage_hints(nodes: DataFrame, links: DataFrame, targets: DataFrame, files: DataFrame) -> DataFrame:
    """(target, processed_at, files_processed, files_total) of the targets whose empty direction later passes may fill.

    Outgoing counts if the target's own file was not processed, incoming if any file was not. files: (path, processed_at).
    """
    kept = links.where(~F.col("link_type").isin(STRUCTURAL))
    ends = kept.select(F.explode(F.array(F.struct(F.col("dst").alias("target"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("target"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    has = ends.select("e.*").groupBy("target").agg(F.max("i").alias("i"), F.max("o").alias("o"))
    total = files.agg(F.count("processed_at").alias("files_processed"), F.count(F.lit(1)).alias("files_total"))
    own = files.groupBy("path").agg(F.max("processed_at").alias("processed_at"))
    want = targets.select("node_key").distinct().join(nodes.select("node_key", "path").dropDuplicates(["node_key"]), "node_key").withColumnRenamed("node_key", "target")
    j = want.join(has, "target", "left").join(own, "path", "left").crossJoin(F.broadcast(total))
    need = ((F.coalesce("o", F.lit(0)) == 0) & F.col("processed_at").isNull()) | ((F.coalesce("i", F.lit(0)) == 0) & (F.col("files_processed") < F.col("files_total")))
    return j.where(need).select("target", "processed_at", "files_processed", "files_total")


def neighbour_slice(nodes: DataFrame, links: DataFrame, targets: DataFrame, limit: int = 10) -> DataFrame:
    """(target, other, name, i): the first limit neighbours of each target, outgoing ones first, each direction by key; limit is the feature."""
    want = targets.select(F.col("node_key").alias("target")).distinct()
    kept = links.where(~F.col("link_type").isin(LEXICAL))
    side = lambda a, b, d: kept.select(F.col(a).alias("target"), F.col(b).alias("other"), F.lit(d).alias("d")).join(want, "target", "left_semi").distinct()
    both = side("src", "dst", 0).unionByName(side("dst", "src", 1)).join(nodes.select(F.col("node_key").alias("other"), "name"), "other")
    i = F.row_number().over(Window.partitionBy("target").orderBy("d", "other")) - 1
    return both.withColumn("i", i).where(F.col("i") < normal_limit(limit)).select("target", "other", "name", "i")


def normal_limit(limit: object, default: int = 10) -> int:
    """The limit if it is a positive integer, else the default."""
    return limit if isinstance(limit, int) and not isinstance(limit, bool) and limit > 0 else default


def merged_search(keyword: DataFrame, exact: DataFrame, neighbours: DataFrame, limit: int = 10) -> DataFrame:
    """(query, layer, id, score, match, position): layers merged by the best score of an id, ties in the order they came.

    keyword: (query, layer, id, i), layer l2 (from 0.90 on) or l3 (from 0.85 on); exact: (query, id), 0.95; neighbours:
    (query, id, i), from 0.70 on; each step down is 0.01.
    """
    score = lambda base: F.lit(base) - F.lit(0.01) * F.col("i")
    k = keyword.select("query", "layer", "id", F.when(F.col("layer") == "l2", score(0.9)).otherwise(score(0.85)).alias("score"), F.lit("keyword").alias("match"), F.when(F.col("layer") == "l2", 0).otherwise(1).alias("part"), "i")
    e = exact.select("query", F.lit("l2").alias("layer"), "id", F.lit(0.95).alias("score"), F.lit("exact").alias("match"), F.lit(2).alias("part"), F.lit(0).alias("i"))
    n = neighbours.select("query", F.lit("l2").alias("layer"), "id", score(0.7).alias("score"), F.lit("neighbor").alias("match"), F.lit(3).alias("part"), "i")
    every = k.unionByName(e).unionByName(n)
    by_id = Window.partitionBy("query", "layer", "id")
    seen = every.withColumn("first", F.min(F.struct("part", "i")).over(by_id)).withColumn("r", F.row_number().over(by_id.orderBy(F.desc("score"), "part", "i"))).where("r = 1")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "first")
    return seen.withColumn("position", F.row_number().over(w)).where(F.col("position") <= normal_limit(limit)).select("query", "layer", "id", F.round("score", 6).alias("score"), "match", "position")


def blast_radius_layers(nodes: DataFrame, links: DataFrame, targets: DataFrame, call_sites: DataFrame) -> DataFrame:
    """(target, name, layer): dependents of each target, layer by layer, each layer without what was shown before.

    direct: distinct sources of non-lexical links (contains stays). rollup, of files: callers of the symbols they
    contain, lifted to their files, without the target and direct ones by key. fallback, of symbols that no
    non-structural link reaches: other files with call sites of their name, without names shown. container, of symbols:
    non-structural dependents of their files, without names shown. call_sites: (file_path, target_function).
    """
    want = targets.select("node_key").distinct().join(nodes.select("node_key", "name", "path", "kind"), "node_key")
    want = want.select(F.col("node_key").alias("target"), F.col("name").alias("own"), F.col("path").alias("own_path"), "kind")
    name = nodes.select(F.col("node_key").alias("other"), F.col("name"), F.col("path").alias("other_path"))
    kept = links.where(~F.col("link_type").isin(LEXICAL)).select("src", "dst", "link_type")
    uses = links.where(~F.col("link_type").isin(STRUCTURAL)).select(F.col("src").alias("other"), F.col("dst").alias("at")).distinct()
    contains = links.where("link_type = 'contains'").select(F.col("src").alias("file"), F.col("dst").alias("symbol")).distinct()

    direct = want.join(kept, F.col("target") == F.col("dst")).select("target", F.col("src").alias("other")).distinct().join(name.select("other", "name"), "other")
    inside = want.where("kind = 'file'").select("target").join(contains, F.col("target") == F.col("file")).join(uses, F.col("symbol") == F.col("at"))
    files = nodes.where("kind = 'file'").select(F.col("path").alias("other_path"), F.col("name").alias("file_name"))
    holder = contains.groupBy(F.col("symbol").alias("other")).agg(F.min("file").alias("holder"))
    lifted = inside.select("target", "other").distinct().join(holder, "other", "left").select("target", F.coalesce("holder", "other").alias("other"))
    lifted = lifted.where("other <> target").distinct().join(name.select("other", "name"), "other")
    rollup = lifted.join(direct.select("target", "other"), ["target", "other"], "left_anti")

    reached = uses.select(F.col("at").alias("target")).distinct()
    bare = want.where("kind <> 'file'").join(reached, "target", "left_anti")
    sites = call_sites.select("file_path", "target_function").dropna().distinct()
    fallback = bare.join(sites, F.col("own") == F.col("target_function")).where("file_path <> own_path").join(files, F.col("file_path") == F.col("other_path")).select("target", F.col("file_name").alias("name")).distinct()
    shown = direct.select("target", "name").unionByName(rollup.select("target", "name")).distinct()
    fallback = fallback.join(shown, ["target", "name"], "left_anti")

    around = want.where("kind <> 'file'").select("target").join(contains, F.col("target") == F.col("symbol")).join(uses, F.col("file") == F.col("at"))
    container = around.join(name.select("other", "name"), "other").select("target", "name").distinct()
    container = container.join(shown.unionByName(fallback).distinct(), ["target", "name"], "left_anti")
    tag = lambda df, layer: df.select("target", "name", F.lit(layer).alias("layer"))
    return tag(direct, "direct").unionByName(tag(rollup, "rollup")).unionByName(tag(fallback, "fallback")).unionByName(tag(container, "container"))


def why(targets: DataFrame, decisions: DataFrame, parts: list[Column]) -> DataFrame:
    """(node_key, why): the decisions of each target as structs of parts, sorted; targets without any have none.

    decisions: (node_key, ...).
    """
    return decisions.join(targets.select("node_key").distinct(), "node_key", "left_semi").groupBy("node_key").agg(F.array_sort(F.collect_set(F.struct(*parts))).alias("why"))
