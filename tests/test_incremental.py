import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.operators import incremental as inc
from gneiss.sources.versioned import ConcurrentCommit, VersionedTable, run_incremental

D = datetime(2025, 1, 1)
DEC = "project_id long, content_hash string, node_type string, title string, content string, extra int"
STATE = "state_id long, project_id long, run_status string, synced_content_hashes array<string>, written_at timestamp"
CHANGE = "project_id long, commit_sha string, commit_seq int, file_path string, arrived_at timestamp"
BATCH = "batch_id long, project_id long, head_sha string, remaining_queue array<struct<file:string,commit_sha:string>>, batch_status string, saved_at timestamp"


def test_pending_decisions(spark):
    made = hashlib.sha256(b"t\nx\ny").hexdigest()
    dec = spark.createDataFrame([(1, "AA", "t", "x", "y", 1), (1, "AA", "t", "x", "y", 1), (1, None, "t", "x", "y", 1), (1, "bb", "", "", "", 0), (2, "cc", None, None, None, 0), (None, "zz", "", "", "", 0)], DEC)
    st = spark.createDataFrame(
        [(1, 1, "succeeded", ["sha256:BB", None], D), (2, 1, "failed", ["aa"], D.replace(day=3)), (3, 1, "succeeded", ["aa", "bb"], D.replace(year=2024)), (4, 2, None, ["cc"], D)], STATE
    )
    none = (spark.createDataFrame([], CHANGE), spark.createDataFrame([], BATCH))
    pending = lambda d, s: {(r["project_id"], r["item_key"]) for r in inc.pending_items(d, s, *none).where("item_kind = 'decision'").collect()}
    assert pending(dec, st) == {(1, "aa"), (1, made), (2, "cc")}
    assert not pending(dec.limit(0), st)
    assert len(pending(dec, st.limit(0))) == 4


def test_pending_files(spark, tmp_path):
    late = D.replace(month=6)
    ch = spark.createDataFrame(
        [(1, "aaaa11", 1, "old", D), (1, "bbbb22", 2, "late", late), (1, "bbbb22", 2, "./head", D), (1, "cccc33", 3, "new", D), (2, "dddd", 1, "any", D), (1, "aaaa11", 1, None, D)], CHANGE
    )
    b = spark.createDataFrame(
        [(1, 1, "bbbb", [("./queued", "x"), ("./queued", "x"), (None, None)], "committed", D.replace(month=3)), (2, 1, "cccc33", None, "crashed", D.replace(month=4))], BATCH
    )
    b = b.unionByName(spark.createDataFrame([(3, 3, "eeee", [("old", "x")], "committed", D.replace(month=3))], BATCH))
    ch = ch.unionByName(spark.createDataFrame([(3, "eeee", 1, "old", D), (3, "eeee", 1, "done", D)], CHANGE))
    none = (spark.createDataFrame([], DEC), spark.createDataFrame([], STATE))
    pending = lambda c, q: {(r["project_id"], r["item_key"]) for r in inc.pending_items(*none, c, q).collect()}
    assert pending(ch, b) == {(1, "late"), (1, "new"), (1, "queued"), (2, "any"), (3, "old")}
    assert not pending(ch.limit(0), b.limit(0))
    # covered files are the first version, queued ones of them a deletion vector of the last
    source = VersionedTable(spark, f"file://{tmp_path}/source", inc.ITEM)
    first = inc.publish_items(source, *none, ch, b)
    assert (first, source.manifest().version) == (0, 2)
    assert {r["item_key"] for r in source.read(0).collect()} == {"old", "head", "done"}
    assert [(r["item_key"], r["_change"]) for r in source.changes(1).collect()] == [("old", "delete")]


def test_versioned_table_diffs_manifests(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    t = VersionedTable(spark, f"file://{tmp_path}/t", schema)
    assert t.read().count() == 0
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    t.commit(rows((1, "a"), (2, "b"), (2, "b")))
    t.commit(rows((3, "c"), (None, None)))
    t.delete(F.col("k") == 1)
    t.compact()
    change = lambda a, b=None: sorted((str(r["k"]), r["_change"]) for r in t.changes(a, b).collect())
    assert change(0, 1) == [("3", "insert"), ("None", "insert")]
    assert change(1, 2) == [("1", "delete")]
    assert change(2, 3) == []  # compaction moves rows only
    assert change(-1) == [("2", "insert"), ("2", "insert"), ("3", "insert"), ("None", "insert")]
    assert t.read(0).count() == 3 and t.read().count() == 4
    with pytest.raises(ConcurrentCommit):
        t.commit(rows((9, "z")), base=0)


def test_failed_run_neither_skips_nor_repeats(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType())])
    src, out = VersionedTable(spark, f"file://{tmp_path}/s", schema), VersionedTable(spark, f"file://{tmp_path}/o", schema)
    src.commit(spark.range(5).toDF("k"))
    keep = lambda df: df.where("_change = 'insert'").select("k")

    def boom(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        run_incremental(src, out, "src", boom)
    run_incremental(src, out, "src", keep)
    run_incremental(src, out, "src", keep)
    src.commit(spark.range(5, 8).toDF("k"))
    run_incremental(src, out, "src", keep)
    assert sorted(r[0] for r in out.read().collect()) == list(range(8))


def test_crash_at_every_step(spark, tmp_path, monkeypatch):
    schema = T.StructType([T.StructField("k", T.LongType())])
    keep = lambda df: df.where("_change = 'insert'").select("k")
    for step in ("write", "create", "publish"):
        src, out = (VersionedTable(spark, f"file://{tmp_path}/{step}-{n}", schema) for n in "so")
        src.commit(spark.range(4).toDF("k"))
        with monkeypatch.context() as m:
            if step == "write":
                m.setattr(VersionedTable, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
            elif step == "create":
                # the temporary file of the commit is left half written
                def half(self, name, body):
                    f = self.fs.create(self._path(f"{self.path}/_log/.half"), True)
                    f.write(bytearray(b'{"version": 0, "ad'))
                    f.close()
                    raise RuntimeError("lost")

                m.setattr(VersionedTable, "_publish", half)
            else:
                m.setattr(VersionedTable, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                run_incremental(src, out, "src", keep)
        assert out.read().count() == 0
        run_incremental(src, out, "src", keep)
        run_incremental(src, out, "src", keep)
        assert sorted(r[0] for r in out.read().collect()) == [0, 1, 2, 3]


def test_checkpoints_of_the_log(spark, tmp_path, monkeypatch):
    import gneiss.sources.versioned as versioned

    monkeypatch.setattr(versioned, "CHECKPOINT", 2)
    schema = T.StructType([T.StructField("k", T.LongType())])
    t = VersionedTable(spark, f"file://{tmp_path}/t", schema)
    for i in range(5):
        t.commit(spark.range(i, i + 1).toDF("k"), processed={"x": i})
    assert "0000000004.checkpoint" in t._names()
    for i in range(5):
        assert t.read(i).count() == i + 1 and t.manifest(i).processed == {"x": i}
