"""Property-graph operators over nodes (node_key, name, path, kind, description) and links (src, dst, link_type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators.maintenance import numbered

LEXICAL = ["lexical_parent", "lexical_owner"]
STRUCTURAL = ["contains", *LEXICAL]


def neighbours(nodes: DataFrame, links: DataFrame, incoming: bool = True, typed: bool = False) -> DataFrame:
    """Distinct neighbours of every node: (node_key, other_key, name, kind[, link_type]).

    Untyped edges leave out lexical links; typed relations keep every link.
    """
    at, other = ("dst", "src") if incoming else ("src", "dst")
    kept = links if typed else links.where(~F.col("link_type").isin(LEXICAL))
    side = nodes.select(F.col("node_key").alias(other), "name", "kind")
    cols = [F.col(at).alias("node_key"), F.col(other).alias("other_key"), "name", "kind", *(["link_type"] if typed else [])]
    return kept.join(side, other).select(*cols).distinct()


def degree_once(links: DataFrame) -> DataFrame:
    """(node_key, degree): links that touch a node; a loop counts once."""
    ends = F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))
    return links.select(F.explode(ends).alias("node_key")).groupBy("node_key").agg(F.count(F.lit(1)).alias("degree"))


def degree_ends(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node_key, degree): link ends at a node, 0 if none; a loop counts twice."""
    n = links.select(F.explode(F.array("src", "dst")).alias("node_key")).groupBy("node_key").agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("node_key").join(n, "node_key", "left").select("node_key", F.coalesce("n", F.lit(0)).alias("degree"))


def ascii_lower(c: Column) -> Column:
    """Lower case of ASCII letters only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def find_by_name(nodes: DataFrame, links: DataFrame, names: DataFrame) -> DataFrame:
    """(wanted, node_key): the best node for each name: exact matches, else names that contain it.

    Order: paths that look like tests last, larger degree, smaller node_key.
    """
    deg = degree_once(links)
    ranked = nodes.join(deg, "node_key", "left").select(
        "node_key", "name", F.coalesce("degree", F.lit(0)).alias("degree"),
        (ascii_lower(F.col("path")).contains("test") | ascii_lower(F.col("path")).contains("spec")).alias("is_test"),
    )
    best = F.min(F.struct("is_test", (-F.col("degree")).alias("d"), "node_key")).alias("b")
    want = names.select("wanted").dropna().distinct()
    exact = ranked.join(want, F.col("name") == F.col("wanted")).groupBy("wanted").agg(best)
    rest = want.join(exact, "wanted", "left_anti")
    # contains as an equi-join: the first letters of the wanted name against all runs of up to three letters of the names
    n = F.length("low")
    runs = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substring(F.col("low"), i, F.lit(k)))
    grams = ranked.withColumn("low", ascii_lower(F.col("name"))).where(n > 0).withColumn(
        "gram", F.explode(F.array_distinct(F.concat(runs(1), runs(2), runs(3))))
    )
    asked = rest.withColumn("low_wanted", ascii_lower(F.col("wanted"))).withColumn("gram", F.substring("low_wanted", 1, 3))
    loose = grams.join(asked, "gram").where(F.contains("low", "low_wanted")).groupBy("wanted").agg(best)
    return exact.unionByName(loose).select("wanted", F.col("b.node_key").alias("node_key"))


def key_range(nodes: DataFrame, prefix: str) -> DataFrame:
    """Nodes of a file and its symbols as a half-open range, which the scan can use."""
    k = F.col("node_key")
    return nodes.where((k == prefix) | ((k >= prefix + "#") & (k < prefix + "$")))


def prune_orphans(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Links whose two ends exist."""
    keys = nodes.select("node_key")
    return links.join(keys, links.src == keys.node_key, "left_semi").join(keys, F.col("dst") == keys.node_key, "left_semi")


def external_incoming(links: DataFrame, batch: DataFrame) -> DataFrame:
    """Distinct links from outside a batch of keys into it."""
    keys = batch.select("node_key")
    return links.join(keys, links.dst == keys.node_key, "left_semi").join(keys, F.col("src") == keys.node_key, "left_anti").distinct()


def bulk_load(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes_loaded, edges_loaded, edges_dropped): edges with an unknown end are dropped and counted."""
    good = prune_orphans(nodes, edges).agg(F.count(F.lit(1)).alias("edges_loaded"))
    every = edges.agg(F.count(F.lit(1)).alias("every"))
    return nodes.agg(F.count(F.lit(1)).alias("nodes_loaded")).join(good).join(every).select(
        "nodes_loaded", "edges_loaded", (F.col("every") - F.col("edges_loaded")).alias("edges_dropped")
    )


def coverage(nodes: DataFrame) -> DataFrame:
    """(total, described)."""
    return nodes.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("description", F.lit("")) != "").alias("described"))


def canary(nodes: DataFrame, n: int = 20) -> DataFrame:
    """The first n names that are not empty, by key."""
    return nodes.where(F.coalesce("name", F.lit("")) != "").orderBy("node_key").limit(n).select("node_key", "name")


def cluster_label(path: Column) -> Column:
    """First min(2, n - 1) segments of a path; '' for a bare file."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(2), F.size(parts) - 1)), "/")


def groups(nodes: DataFrame) -> DataFrame:
    """(group_id, label, n): ids by the first node key of each group."""
    g = nodes.groupBy(cluster_label(F.col("path")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min("node_key").alias("k"))
    return numbered(g, ["k"]).select((F.col("position") - 1).alias("group_id"), "label", "n")


def collapse_to_files(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(source, target, link_type, n): links lifted to the files of their ends, without links inside a file or to unknown nodes."""
    f = nodes.select("node_key", "path")
    a = f.select(F.col("node_key").alias("src"), F.col("path").alias("source"))
    b = f.select(F.col("node_key").alias("dst"), F.col("path").alias("target"))
    lifted = links.where(~F.col("link_type").isin(STRUCTURAL)).join(a, "src").join(b, "dst").where("source <> target")
    return lifted.groupBy("source", "target", "link_type").agg(F.count(F.lit(1)).alias("n"))


def topology(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label, group_label, degree) of every node over the links that don't dangle."""
    kept = prune_orphans(nodes, links).dropDuplicates(["src", "dst", "link_type"])
    return nodes.join(degree_ends(nodes, kept), "node_key").select(
        F.col("node_key").alias("id"), F.col("name").alias("label"), cluster_label(F.col("path")).alias("group_label"), "degree"
    )


def tag_lists(bridge: DataFrame) -> DataFrame:
    """(node_key, tags): sorted distinct tags of each node."""
    return bridge.dropna().groupBy("node_key").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def disambiguate(symbols: DataFrame) -> DataFrame:
    """(row_id, node_key): base, base@Lline for later ones of a base, and ...#n for later ones of a line."""
    a = Window.partitionBy("base").orderBy("row_id")
    b = Window.partitionBy("base", "line").orderBy("row_id")
    first = F.row_number().over(a) == 1
    n = F.row_number().over(b)
    return symbols.select(
        "row_id",
        F.when(first, F.col("base")).when(n == 1, F.concat("base", F.lit("@L"), "line")).otherwise(F.concat("base", F.lit("@L"), "line", F.lit("#"), n.cast("string"))).alias("node_key"),
    )


def innermost(spans: DataFrame, points: DataFrame) -> DataFrame:
    """(point_id, path, symbol): the smallest span of its path that holds a line; the path itself if none or a tie.

    The join is on the path, so a line meets the spans of its own file only.
    """
    s = spans.select(F.col("path").alias("p"), "symbol", "start_line", "end_line")
    hit = points.join(s, (F.col("path") == F.col("p")) & (F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line")), "left")
    size = F.col("end_line") - F.col("start_line")
    w = Window.partitionBy("point_id")
    least = hit.withColumn("size", size).withColumn("m", F.min("size").over(w)).where(F.col("symbol").isNull() | (F.col("size") == F.col("m")))
    return least.groupBy("point_id", "path").agg(
        F.when((F.count("symbol") == 1), F.max("symbol")).otherwise(F.col("path")).alias("symbol")
    )
