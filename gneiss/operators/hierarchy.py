"""Parent-child links to full hierarchies by pointer doubling.

Every node points at an ancestor and knows the distance. A round replaces the
pointer by the pointer of the node pointed at, so the reach doubles; a node is
done when it points at a root. A round in which no node gets done proves that
all nodes left are on a cycle or below one: any acyclic node left would have an
ancestor that this round finishes.

Defined cases: null or blank ends are dropped; repeated edges count once; a
node with several parents keeps the smallest parent key; an edge from a node to
itself is a cycle; an empty input gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gneiss.storage import Scratch, collect_garbage

CYCLE = "cycle"


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def contains_edges(edges: DataFrame) -> DataFrame:
    """(parent, child) of the contains links with two non-blank ends."""
    return edges.where(
        (F.lower(F.trim("link_type")) == "contains")
        & ~_blank(F.col("source_key"))
        & ~_blank(F.col("target_key"))
    ).select(F.col("source_key").alias("parent"), F.col("target_key").alias("child"))


def _nodes(links: DataFrame) -> DataFrame:
    """(key, parent, inner): one row a node; parent null for a root; inner: has children.

    One shuffle with map-side combine; a parent of very many children is
    reduced to one row a map task before it.
    """
    ends = F.explode(
        F.array(
            F.struct(F.col("child").alias("key"), F.col("parent").alias("parent"), F.lit(False).alias("inner")),
            F.struct(F.col("parent").alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(True).alias("inner")),
        )
    )
    return (
        links.select(ends.alias("e"))
        .select("e.*")
        .groupBy("key")
        .agg(F.min("parent").alias("parent"), F.max("inner").alias("inner"))
    )


def _id(prefix: str, key: str) -> list[Column]:
    """128 bits that stand for a key in the rounds."""
    c = F.col(key)
    return [F.xxhash64(c).alias(f"{prefix}1"), F.xxhash64(F.lit(7919), c).alias(f"{prefix}2")]


def _rounds(scratch: Scratch, start: DataFrame, step) -> tuple[list[DataFrame], DataFrame]:
    """Run doubling rounds; the done parts, and what is on or below cycles.

    start has the columns done and inner (can be pointed at). Rows done earlier
    never change, so each round writes only the rows that were still open.
    """
    done = [start.where("done")]
    fixed = start.where("done AND inner")
    current = start
    while True:
        seen = Observation()
        still = F.expr("NOT done")
        grown = step(current.where(still), fixed.unionByName(current.where(still & F.col("inner"))))
        nxt = scratch.keep(grown.observe(seen, F.count_if("done").alias("finished"), F.count(F.lit(1)).alias("rows")))
        finished, rows = seen.get["finished"], seen.get["rows"]
        if finished:
            done.append(nxt.where("done"))
            fixed = fixed.unionByName(nxt.where("done AND inner"))
        if not finished or finished == rows:
            return done, nxt.where("NOT done")
        current = nxt
        collect_garbage(scratch.spark)


def resolve(links: DataFrame) -> DataFrame:
    """(node_key, root_key, depth) of every node; 'cycle' and -1 on or below a cycle.

    links: (parent, child). The rounds carry 128-bit ids instead of keys; the
    keys come back in two joins at the end.
    """
    scratch = Scratch(links.sparkSession, "hierarchy")
    nodes = scratch.keep(_nodes(links))
    root = F.col("parent").isNull()
    ids = nodes.select(
        *_id("k", "key"),
        *[F.when(root, k).otherwise(p).alias(f"a{i}") for i, (k, p) in enumerate(zip(_id("k", "key"), _id("p", "parent")), 1)],
        F.when(root, 0).otherwise(1).alias("d"),
        root.alias("done"),
        "inner",
    )

    def step(todo: DataFrame, look: DataFrame) -> DataFrame:
        up = look.select(
            F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"),
            F.col("d").alias("e"), F.col("done").alias("up_done"),
        )
        t = todo.drop("done")
        return t.join(up, (t.a1 == up.u1) & (t.a2 == up.u2)).select(
            "k1", "k2", F.col("b1").alias("a1"), F.col("b2").alias("a2"), (F.col("d") + F.col("e")).alias("d"),
            F.col("up_done").alias("done"), "inner",
        )

    done, stuck = _rounds(scratch, ids, step)
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    flat = found.select("k1", "k2", "a1", "a2", "d").unionByName(
        stuck.select("k1", "k2", F.lit(None).cast("long").alias("a1"), F.lit(None).cast("long").alias("a2"), F.lit(-1).alias("d"))
    )
    names = nodes.select(*_id("k", "key"), F.col("key").alias("node_key"))
    roots = nodes.where(root).select(*_id("a", "key"), F.col("key").alias("root_key"))
    return (
        flat.join(names, ["k1", "k2"])
        .join(roots, ["a1", "a2"], "left")
        .select("node_key", F.coalesce("root_key", F.lit(CYCLE)).alias("root_key"), F.col("d").cast("int").alias("depth"))
    )


def ancestors(links: DataFrame) -> DataFrame:
    """(node_key, chain, depth): chain is the array of ancestors from the root down, null on or below a cycle.

    Doubling that also joins the path segments of the two halves.
    """
    scratch = Scratch(links.sparkSession, "ancestors")
    nodes = scratch.keep(_nodes(links))
    root = F.col("parent").isNull()
    empty = F.array().cast("array<string>")
    # chain: from the ancestor pointed at, which it begins with, to the parent
    start = nodes.select(
        "key",
        F.coalesce("parent", "key").alias("up"),
        F.when(root, empty).otherwise(F.array("parent")).alias("chain"),
        root.alias("done"),
        "inner",
    )

    def step(todo: DataFrame, look: DataFrame) -> DataFrame:
        above = look.select(
            F.col("key").alias("at"), F.col("up").alias("up2"), F.col("chain").alias("chain2"), F.col("done").alias("done2")
        )
        t = todo.drop("done")
        return t.join(above, t.up == above["at"]).select(
            "key", F.col("up2").alias("up"), F.concat("chain2", "chain").alias("chain"), F.col("done2").alias("done"), "inner"
        )

    done, stuck = _rounds(scratch, start, step)
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return found.select(F.col("key").alias("node_key"), "chain", F.size("chain").alias("depth")).unionByName(
        stuck.select(F.col("key").alias("node_key"), F.lit(None).cast("array<string>").alias("chain"), F.lit(-1).alias("depth"))
    )


def paths(links: DataFrame, separator: str = " > ") -> DataFrame:
    """(node_key, path, root_key, depth, n_descendants); path null, 'cycle', -1 and -1 on or below a cycle."""
    chains = Scratch(links.sparkSession, "paths").keep(ancestors(links))
    counts = (
        chains.where(F.col("depth") > 0)
        .select(F.explode("chain").alias("node_key"))
        .groupBy("node_key")
        .agg(F.count(F.lit(1)).alias("below"))
    )
    cyclic = F.col("chain").isNull()
    return chains.join(counts, "node_key", "left").select(
        "node_key",
        F.when(~cyclic, F.concat_ws(separator, F.concat("chain", F.array("node_key")))).alias("path"),
        F.when(cyclic, CYCLE).otherwise(F.coalesce(F.try_element_at("chain", F.lit(1)), "node_key")).alias("root_key"),
        "depth",
        F.when(cyclic, -1).otherwise(F.coalesce("below", F.lit(0))).cast("long").alias("n_descendants"),
    )


def descendants(links: DataFrame) -> DataFrame:
    """(node_key, descendant_key, distance): every descendant of every node of a tree; none for nodes on or below cycles."""
    return (
        ancestors(links)
        .where(F.col("depth") > 0)
        .select(F.posexplode("chain").alias("at", "node_key"), F.col("node_key").alias("descendant_key"), "depth")
        .select("node_key", "descendant_key", (F.col("depth") - F.col("at")).cast("int").alias("distance"))
    )
