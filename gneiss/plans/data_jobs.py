"""Queries of the general data-processing operators: p2 (incremental runs) and p6 (hierarchies)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gneiss.operators import hierarchy, incremental
from gneiss.sources.tables import table


def _items(spark: SparkSession, d: str) -> DataFrame:
    return incremental.pending_items(
        *(table(spark, d, t) for t in ("decisions", "sync_states", "file_changes", "pending_batches"))
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d)


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return incremental.delta_counts(_items(spark, d))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.contains_edges(table(spark, d, "graph_edges"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve(_links(spark, d))


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.paths(_links(spark, d))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_links(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p6_found, p6_paths, p6_descendants)}

_P2 = r"""
WITH st AS (
  SELECT project_id, synced_content_hashes,
         row_number() OVER (PARTITION BY project_id ORDER BY written_at DESC, state_id DESC) AS n
  FROM sync_states WHERE lower(trim(run_status)) = 'succeeded'),
synced AS (SELECT DISTINCT project_id, regexp_replace(lower(trim(h)), '^sha256:', '') AS item_key
  FROM (SELECT project_id, unnest(synced_content_hashes) AS h FROM st WHERE n = 1)),
dec AS (SELECT DISTINCT project_id, CASE WHEN coalesce(trim(content_hash), '') = ''
    THEN sha256(coalesce(node_type,'') || chr(10) || coalesce(title,'') || chr(10) || coalesce(content,''))
    ELSE regexp_replace(lower(trim(content_hash)), '^sha256:', '') END AS item_key FROM decisions),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY saved_at DESC, batch_id DESC) AS n
  FROM pending_batches WHERE lower(trim(batch_status)) = 'committed') WHERE n = 1),
head AS (SELECT b.project_id, max(f.commit_seq) AS head_seq FROM b JOIN file_changes f
  ON f.project_id = b.project_id AND starts_with(lower(f.commit_sha), lower(b.head_sha)) GROUP BY 1),
files AS (SELECT DISTINCT f.project_id, regexp_replace(f.file_path, '^(\./)+', '') AS item_key
  FROM file_changes f LEFT JOIN b ON b.project_id = f.project_id LEFT JOIN head h ON h.project_id = f.project_id
  WHERE b.project_id IS NULL OR h.head_seq IS NULL OR f.commit_seq > h.head_seq OR f.arrived_at > b.saved_at),
q AS (SELECT project_id, regexp_replace(e.file, '^(\./)+', '') AS item_key
  FROM (SELECT project_id, unnest(remaining_queue) AS e FROM b) WHERE e.file IS NOT NULL),
items AS (
SELECT d.project_id, 'decision' AS item_kind, d.item_key FROM dec d LEFT JOIN synced s
  ON s.project_id = d.project_id AND s.item_key = d.item_key
  WHERE s.item_key IS NULL AND d.project_id IS NOT NULL
UNION SELECT project_id, 'file', item_key FROM files WHERE item_key <> ''
UNION SELECT project_id, 'file', item_key FROM q WHERE item_key <> '')
"""

_P6 = """
WITH RECURSIVE e AS (
  SELECT target_key AS child, min(source_key) AS parent FROM graph_edges
  WHERE lower(trim(link_type)) = 'contains' AND trim(coalesce(source_key, '')) <> '' AND trim(coalesce(target_key, '')) <> ''
  GROUP BY 1),
n AS (SELECT child AS k FROM e UNION SELECT source_key FROM graph_edges
  WHERE lower(trim(link_type)) = 'contains' AND trim(coalesce(source_key, '')) <> '' AND trim(coalesce(target_key, '')) <> ''),
r AS (
  SELECT k AS node_key, k AS root_key, 0 AS depth, k AS path, [k] AS chain FROM n WHERE k NOT IN (SELECT child FROM e)
  UNION ALL
  SELECT e.child, r.root_key, r.depth + 1, r.path || ' > ' || e.child, list_append(r.chain, e.child) FROM r JOIN e ON e.parent = r.node_key)
"""

ORACLE = {
    "p2_found": _P2 + "SELECT project_id, item_kind, item_key FROM items",
    "p2_counts": _P2
    + "SELECT project_id, count(*) FILTER (item_kind = 'decision') AS decisions, count(*) FILTER (item_kind = 'file') AS files FROM items GROUP BY 1",
    "p6_found": _P6
    + "SELECT n.k AS node_key, coalesce(r.root_key, 'cycle') AS root_key, coalesce(r.depth, -1)::INT AS depth FROM n LEFT JOIN r ON r.node_key = n.k",
    "p6_paths": _P6
    + """, d AS (SELECT a AS node_key, count(*) AS below FROM (SELECT node_key, unnest(chain) AS a FROM r) WHERE a <> node_key GROUP BY 1)
SELECT n.k AS node_key, r.path, coalesce(r.root_key, 'cycle') AS root_key, coalesce(r.depth, -1)::INT AS depth,
  (CASE WHEN r.node_key IS NOT NULL THEN coalesce(d.below, 0) ELSE -1 END)::BIGINT AS n_descendants
FROM n LEFT JOIN r ON r.node_key = n.k LEFT JOIN d ON d.node_key = n.k""",
    "p6_descendants": _P6
    + """SELECT chain[i] AS node_key, node_key AS descendant_key, (depth + 1 - i)::INT AS distance
FROM (SELECT node_key, chain, depth, unnest(range(1, depth + 1)) AS i FROM r WHERE depth > 0)""",
}
