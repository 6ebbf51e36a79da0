"""Queries of the llm operators with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gneiss.llm import encode, handmade, leaks, overlap, splits, subjects, syntax
from gneiss.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.family_pairs(table(spark, d, "corpus_samples"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "corpus_samples"))


def p1_families(spark: SparkSession, d: str) -> DataFrame:
    return splits.family_components(table(spark, d, "corpus_samples"))


def p1_invariants(spark: SparkSession, d: str) -> DataFrame:
    return splits.invariants(table(spark, d, "corpus_samples"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.sample_pairs(table(spark, d, "corpus_samples")).select("sample_a", "sample_b")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "corpus_samples"))


def p3_contained(spark: SparkSession, d: str) -> DataFrame:
    return overlap.contained_records(table(spark, d, "corpus_samples"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.broken_files(table(spark, d, "parse_requests")).select("task_id").distinct()


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.broken_rates(table(spark, d, "parse_requests"))


def p4_rules(spark: SparkSession, d: str) -> DataFrame:
    return syntax.broken_rules(table(spark, d, "parse_requests"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return handmade.not_handwritten(table(spark, d, "parse_requests")).select("task_id")


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    return handmade.handwritten_rates(table(spark, d, "parse_requests"))


def p5_rules(spark: SparkSession, d: str) -> DataFrame:
    return handmade.rules(table(spark, d, "parse_requests"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items")
    return leaks.leaked_items(leaks.leaks(table(spark, d, "documents"), items), items)


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leaks.without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = subjects.document_areas(table(spark, d, "documents"), table(spark, d, "subject_examples"))
    return found.select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(table(spark, d, "documents"), table(spark, d, "subject_examples"))


QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p1_families, p1_invariants, p3_found, p3_report, p3_contained, p4_found, p4_rates, p4_rules, p5_found, p5_reasons, p5_rules, p7_ids, p8_found, p8_items, p8_cleaned, p9_found, p9_composition)}

_FAMILY = r"""
WITH RECURSIVE k AS (
  SELECT sample_id, lower(trim(repo_family)) AS f0, lower(trim(repo_id)) AS r0, lower(trim(duplicate_group)) AS d0 FROM corpus_samples),
m AS (SELECT sample_id,
  CASE WHEN f0 NOT IN ('', 'unknown', 'n/a') THEN regexp_extract(regexp_replace(replace(f0, ':', '/'), '(/|\.git)+$', ''), '([^/]+/[^/]+)$', 1) END AS f,
  CASE WHEN r0 NOT IN ('', 'unknown', 'n/a') THEN r0 END AS r,
  CASE WHEN d0 NOT IN ('', 'unknown', 'n/a') AND NOT regexp_matches(d0, '^0+$') THEN d0 END AS d FROM k),
keys AS (SELECT DISTINCT sample_id, 'f:' || f AS k FROM m WHERE f IS NOT NULL UNION SELECT sample_id, 'r:' || r FROM m WHERE r IS NOT NULL
  UNION SELECT sample_id, 'd:' || d FROM m WHERE d IS NOT NULL),
pairs AS (SELECT DISTINCT a.k AS u, b.k AS v FROM keys a JOIN keys b USING (sample_id) WHERE a.k <> b.k),
hop AS (SELECT DISTINCT p.u, q.v FROM pairs p JOIN pairs q ON p.v = q.u WHERE p.u LIKE 'f:%' AND q.v LIKE 'f:%' AND p.u <> q.v
  UNION SELECT DISTINCT p.u, s.v FROM pairs p JOIN pairs q ON p.v = q.u JOIN pairs s ON q.v = s.u
    WHERE p.u LIKE 'f:%' AND s.v LIKE 'f:%' AND p.v NOT LIKE 'f:%' AND q.v NOT LIKE 'f:%' AND p.u <> s.v),
reach AS (SELECT u, v FROM hop UNION SELECT r.u, h.v FROM reach r JOIN hop h ON r.v = h.u)
"""

ORACLE = {
    "p1_found": _FAMILY + "SELECT DISTINCT substr(u, 3) AS family_a, substr(v, 3) AS family_b FROM reach WHERE u < v",
    "p1_invariants": "SELECT count(DISTINCT sample_id) AS n_samples, 0::BIGINT AS n_divided, true AS balanced FROM corpus_samples",
}
