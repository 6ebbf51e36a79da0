"""What a run still has to process: deltas between immutable manifests.

The records are kept as a versioned table (sources/versioned.py). What the last
successful run covered, by the state it left, is one version; the records since
then, changed or late ones included, are the files that the next version adds;
covered records that the state hands back (its remaining queue) are masked by a
deletion vector. A run takes the delta from the two manifests, reading only
added and removed files and new vectors, and publishes its output together with
the version that it has processed in one commit. So a run that fails leaves
nothing behind, and the next one computes the same delta again; one that finds
nothing new does nothing.

Defined cases: null keys belong to no delta; repeated entries count once; a
scope without a processed manifest yields all its entries; empty tables give an
empty delta; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.sources.versioned import VersionedTable, run_incremental
from gneiss.storage import Scratch


def latest_per(df: DataFrame, scope: str, order: list[str], where: Column, keep: list[str]) -> DataFrame:
    """The columns keep of the last row, by order, of each scope among the rows where.

    The position of the last row is aggregated first, without the kept columns,
    so that large arrays of older rows never move.
    """
    rows = df.where(where & F.col(scope).isNotNull())
    last = rows.groupBy(scope).agg(F.max(F.struct(*order)).alias("_last")).select(
        F.col(scope).alias("_scope"), *[F.col(f"_last.{c}").alias(f"_{c}") for c in order]
    )
    at = (F.col(scope) == F.col("_scope")) & F.lit(True)
    for c in order:
        at = at & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(last, at, "left_semi").select(scope, *keep).dropDuplicates([scope])


def content_hash(given: Column, parts: list[Column]) -> Column:
    """Lower-case hash without prefix; a missing one is sha256 of the parts joined by newlines (null parts as '')."""
    plain = F.regexp_replace(F.lower(F.trim(given)), "^sha256:", "")
    made = F.sha2(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]), 256)
    return F.when(F.coalesce(plain, F.lit("")) == "", made).otherwise(plain)


def _decisions(decisions: DataFrame, sync_states: DataFrame) -> DataFrame:
    """(project_id, item_key, covered): distinct content hashes; covered by the latest succeeded state of their project.

    Ties on written_at go to the larger state_id.
    """
    current = decisions.select(
        "project_id",
        content_hash(F.col("content_hash"), [F.col("node_type"), F.col("title"), F.col("content")]).alias("item_key"),
    )
    state = latest_per(
        sync_states, "project_id", ["written_at", "state_id"], F.lower(F.trim("run_status")) == "succeeded", ["synced_content_hashes"]
    )
    synced = state.select("project_id", F.explode("synced_content_hashes").alias("h")).select(
        "project_id", F.regexp_replace(F.lower(F.trim("h")), "^sha256:", "").alias("item_key")
    )
    # one aggregation instead of two distincts and a join
    both = current.withColumn("now", F.lit(True)).unionByName(synced.withColumn("now", F.lit(False))).dropna(subset=["project_id", "item_key"])
    return both.groupBy("project_id", "item_key").agg(F.max("now").alias("now"), (~F.min("now")).alias("covered")).where("now").drop("now")


def _files(file_changes: DataFrame, pending_batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((project_id, item_key, covered), (project_id, item_key)): changed files, and the queues.

    The latest committed batch of a project covers the changes up to the commit
    of head_sha (which may be a prefix) that had arrived when it was saved. A
    head_sha that names no known commit covers nothing. Changes are reduced to
    one row a file before any join: one change beyond either bound exists
    exactly if the largest is beyond it.
    """
    plain = lambda c: F.regexp_replace(F.trim(c), r"^(\./)+", "")
    batch = latest_per(
        pending_batches,
        "project_id",
        ["saved_at", "batch_id"],
        F.lower(F.trim("batch_status")) == "committed",
        ["head_sha", "saved_at", "remaining_queue"],
    )
    commits = file_changes.groupBy("project_id", F.lower("commit_sha").alias("sha")).agg(F.max("commit_seq").alias("seq"))
    named = batch.select(F.col("project_id").alias("p"), F.lower(F.trim("head_sha")).alias("head")).where(F.length("head") >= 4)
    heads = (
        named.join(
            commits,
            (F.col("p") == F.col("project_id")) & (F.substring("head", 1, 4) == F.substring("sha", 1, 4)) & F.col("sha").startswith(F.col("head")),
        )
        .groupBy("p")
        .agg(F.max("seq").alias("head_seq"))
    )
    bounds = batch.join(heads, F.col("project_id") == F.col("p"), "left").select("project_id", "head_seq", "saved_at")
    files = (
        file_changes.select("project_id", plain(F.col("file_path")).alias("item_key"), "commit_seq", "arrived_at")
        .where((F.col("item_key") != "") & F.col("project_id").isNotNull())
        .groupBy("project_id", "item_key")
        .agg(F.max("commit_seq").alias("seq"), F.max("arrived_at").alias("arrived"))
    )
    covered = (F.col("seq") <= F.col("head_seq")) & (F.coalesce("arrived", F.lit("1970-01-01").cast("timestamp")) <= F.col("saved_at"))
    queue = batch.select("project_id", F.explode("remaining_queue").alias("q")).select(
        "project_id", plain(F.col("q.file")).alias("item_key")
    )
    known = files.join(bounds, "project_id", "left").select("project_id", "item_key", F.coalesce(covered, F.lit(False)).alias("covered"))
    return known, queue.where(F.col("item_key") != "").dropna().distinct()


ITEM = T.StructType([T.StructField("project_id", T.LongType()), T.StructField("item_kind", T.StringType()), T.StructField("item_key", T.StringType())])


def publish_items(source: VersionedTable, decisions: DataFrame, sync_states: DataFrame, file_changes: DataFrame, pending_batches: DataFrame) -> int:
    """Bring the records into a versioned table; the number of the version that the last successful run covered.

    Its first commit holds what the states cover, the second adds the files of
    the other records, the third masks the covered records of the queues.
    """
    kind = lambda df, name: df.withColumn("item_kind", F.lit(name))
    known, queue = _files(file_changes, pending_batches)
    files = known.withColumn("queued", F.lit(False)).unionByName(queue.withColumns({"covered": F.lit(None).cast("boolean"), "queued": F.lit(True)}))
    files = files.groupBy("project_id", "item_key").agg(F.coalesce(F.bool_and("covered"), F.lit(False)).alias("covered"), F.max("queued").alias("queued"))
    decided = kind(_decisions(decisions, sync_states), "decision").withColumn("queued", F.lit(False))
    items = Scratch(decisions.sparkSession, "items").keep(decided.unionByName(kind(files, "file")))
    covered = source.commit(items.where("covered").select(*ITEM.names))
    source.commit(items.where("NOT covered").select(*ITEM.names))
    source.delete_keys(items.where("covered AND queued").select(*ITEM.names))
    return covered


def pending_items(decisions: DataFrame, sync_states: DataFrame, file_changes: DataFrame, pending_batches: DataFrame) -> DataFrame:
    """(project_id, item_kind, item_key) of everything still to be processed: the output of one incremental run."""
    spark = decisions.sparkSession
    root = Scratch(spark, "versions").folder()
    source, sink = VersionedTable(spark, f"{root}/source", ITEM), VersionedTable(spark, f"{root}/pending", ITEM)
    covered = publish_items(source, decisions, sync_states, file_changes, pending_batches)
    sink.commit(processed={"items": covered})
    run_incremental(source, sink, "items", lambda delta: delta.select(*ITEM.names))
    return sink.read().distinct()


def delta_counts(items: DataFrame) -> DataFrame:
    """(project_id, decisions, files): sizes of the delta per project."""
    return items.groupBy("project_id").agg(
        F.count_if(F.col("item_kind") == "decision").alias("decisions"), F.count_if(F.col("item_kind") == "file").alias("files")
    )


def last_changes(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last change of every key by order; ties broken by all other columns, so that a rerun gives the same rows."""
    rest = [F.col(c).desc_nulls_last() for c in sorted(set(changes.columns) - set(key) - set(order)) if not dict(changes.dtypes)[c].startswith("map")]
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order], *rest)
    return changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
