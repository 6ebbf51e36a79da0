"""Connected components of an undirected graph by alternating large and small stars.

Each round replaces the edges by edges to smaller keys until every edge joins a
node with the smallest key of its component. No neighbourhood is collected: a
round is aggregations of a minimum, joins and a distinct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gneiss.storage import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest key of it.

    Null ends and edges from a node to itself relate nothing; repeated edges
    count once; without edges the result is empty.
    """
    scratch = Scratch(edges.sparkSession, "components")

    def marked(df: DataFrame) -> tuple[DataFrame, tuple]:
        """Edges written, so that a round's plan begins at them; their number and the sum of their hashes."""
        seen = Observation()
        mark = F.xxhash64("u", "v").cast("decimal(38,0)")
        out = scratch.keep(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(mark).alias("mark")))
        return out, (seen.get["n"], seen.get["mark"])

    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    kept, before = marked(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        large = scratch.keep(_large_star(kept))
        nxt, now = marked(_small_star(large))
        scratch.free(kept, large)
        kept = nxt
        if now == before:
            break
        before = now
    roots = kept.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return kept.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
