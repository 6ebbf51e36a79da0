"""Snapshots as JSON lines, and decision cards as Markdown with JSON front matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES = T.StructType([T.StructField(c, T.StringType()) for c in ("node_key", "name", "path", "kind", "description")])
LINKS = T.StructType([T.StructField(c, T.StringType()) for c in ("src", "dst", "link_type")])
CARD = "content_hash string, title string, node_type string, commits array<string>"


def write_snapshot(nodes: DataFrame, links: DataFrame, path: str) -> None:
    """nodes/ and links/ as JSON lines in canonical order: sorted by ranges over many files, so no task holds all."""
    nodes.select(*NODES.names).orderBy("node_key").write.mode("overwrite").json(f"{path}/nodes", ignoreNullFields=False)
    links.select(*LINKS.names).orderBy("src", "dst", "link_type").write.mode("overwrite").json(f"{path}/links", ignoreNullFields=False)


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links); one malformed line fails the read."""
    read = lambda name, schema: spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{name}")
    return read("nodes", NODES), read("links", LINKS)


def read_all_or_nothing(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """Rows of a JSON-lines file, or none at all if one line is malformed, lacks the key, or repeats it."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    bad = rows.agg(
        (F.coalesce(F.max(F.col("_corrupt").isNotNull() | F.col(key).isNull()), F.lit(False)) | (F.count(F.lit(1)) != F.countDistinct(key))).alias("bad")
    )
    return rows.drop("_corrupt").join(F.broadcast(bad), ~F.col("bad")).drop("bad")


def render_cards(decisions: DataFrame) -> DataFrame:
    """(content_hash, card): front matter between --- lines, then the content."""
    front = F.to_json(F.struct("content_hash", "title", "node_type", "commits"))
    return decisions.select("content_hash", F.concat(F.lit("---\n"), front, F.lit("\n---\n"), F.coalesce("content", F.lit(""))).alias("card"))


def parse_cards(cards: DataFrame) -> DataFrame:
    """(content_hash, title, node_type, commits, content) of the well-formed cards."""
    p = r"^---\n([^\n]*)\n---\n([\s\S]*)$"
    j = cards.select(F.from_json(F.regexp_extract("card", p, 1), CARD).alias("j"), F.regexp_extract("card", p, 2).alias("content"))
    return j.where("j.content_hash IS NOT NULL").select("j.*", "content")


def import_cards(cards: DataFrame, known: DataFrame) -> DataFrame:
    """Cards whose hash is not known yet, one of each hash."""
    return parse_cards(cards).dropDuplicates(["content_hash"]).join(known.select("content_hash").distinct(), "content_hash", "left_anti")
