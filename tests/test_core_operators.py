import sqlite3

import pytest
from pyspark.sql import functions as F

from gneiss.functions import stats, text
from gneiss.operators import components, context, discovery, evaluation, graph, impact, maintenance, records, resolution, search
from gneiss.sources import snapshot


def test_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "y"), (None, "a"), ("c", "a"), ("q", "q")], "u string, v string")
    assert {r[0]: r[1] for r in components.connected_components(e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    chain = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(40)], "u string, v string")
    assert {r[1] for r in components.connected_components(chain).collect()} == {"000"}
    assert components.connected_components(e.limit(0)).count() == 0


def test_degrees_differ_on_loops(spark):
    n = spark.createDataFrame([("a", "A", "a", "file", ""), ("b", "B", "b", "file", ""), ("c", "C", "c", "file", None)], "node_key string, name string, path string, kind string, description string")
    li = spark.createDataFrame([("a", "a", "calls"), ("a", "b", "lexical_parent"), ("b", "a", "contains")], "src string, dst string, link_type string")
    assert {r[0]: r[1] for r in graph.degree_once(li).collect()} == {"a": 3, "b": 2}
    assert {r[0]: r[1] for r in graph.degree_ends(n, li).collect()} == {"a": 4, "b": 2, "c": 0}
    assert {(r[0], r[1]) for r in graph.neighbours(n, li).select("node_key", "other_key").collect()} == {("a", "a"), ("a", "b")}
    assert graph.bulk_load(n.where("node_key <> 'b'"), li).first()[:] == (2, 1, 2)
    assert impact.risk_levels(n, li).count() == 3


def test_closure_runs_to_the_end(spark):
    chain = [(f"n{i:02}", f"n{i + 1:02}", "calls") for i in range(20)]
    li = spark.createDataFrame([*chain, ("n20", "n18", "calls"), ("n05", "n05", "calls")], "src string, dst string, link_type string")
    got = {(r["start"], r["node"]): r["hops"] for r in impact.closure(li, spark.createDataFrame([("n00",), ("n18",)], "node_key string")).collect()}
    assert got == {**{("n00", f"n{i:02}"): i for i in range(21)}, ("n18", "n18"): 0, ("n18", "n19"): 1, ("n18", "n20"): 2}


def test_name_lookup_falls_back_to_contains(spark):
    n = spark.createDataFrame([("k1", "Runner", "test/x"), ("k2", "Runner", "src/x"), ("k3", "QueryRunner", "src/q"), ("k4", None, None)], "node_key string, name string, path string")
    li = spark.createDataFrame([("k1", "k3", "calls")], "src string, dst string, link_type string")
    want = spark.createDataFrame([("Runner",), ("ERYRU",), ("u",), ("none",), (None,)], "wanted string")
    assert {r[0]: r[1] for r in graph.find_by_name(n, li, want).collect()} == {"Runner": "k2", "ERYRU": "k3", "u": "k3"}


def test_search_agrees_with_fts(spark):
    docs = [(1, "queryRunner", "runs the query"), (2, "foo_bar", "lib/foo/bar.ts running"), (3, "auth", "OR auth operator literal"), (4, "", None), (5, "runner", "the the run")]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table f using fts5(name, body, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    con.executemany("insert into f(rowid, name, body) values (?,?,?)", docs)
    index = search.inverted_index(spark.createDataFrame(docs, "id long, name string, body string"), "id", ["name", "body"])
    for q in (["run"], ["foo_bar"], ["foo/bar"], ["auth", "operator"], ["auth", "absent"], ["runner"]):
        both = " AND ".join(f'"{w}"' for w in q)
        want = [r[0] for r in con.execute("select rowid from f where f match ? order by rank, rowid", (both,))]
        if not want:
            want = [r[0] for r in con.execute("select rowid from f where f match ? order by rank, rowid", (both.replace(" AND ", " OR "),))]
        kw = spark.createDataFrame([("q", q)], "query string, keywords array<string>")
        got = [r["key"] for r in search.top_k(search.bm25(index, search.phrases(kw)), pool=False).orderBy("rank").collect()]
        assert got == want, q


def test_stems():
    known = {"running": "run", "relational": "relat", "conditional": "condit", "hopping": "hop", "hoping": "hope", "happy": "happi", "ponies": "poni", "generalizations": "gener", "agreed": "agre", "is": "is", "sky": "sky"}
    assert {w: text.stem(w) for w in known} == known


def test_exact_bounds(spark):
    assert abs(stats.lower_bound(299, 299) - 0.05 ** (1 / 299)) < 1e-12 and stats.least_zero_error(0.99) == 299
    assert stats.lower_bound(0, 10) == 0.0 and stats.lower_bound(0, 0) is None
    b = stats.lower_bound(8, 10)
    tail = sum(__import__("math").comb(10, i) * b**i * (1 - b) ** (10 - i) for i in range(8, 11))
    assert abs(tail - 0.05) < 1e-9
    assert stats.isotonic([1, 2, 3, 4], [1, 1, 1, 1], [0.1, 0.5, 0.3, 0.9]) == [0.1, 0.4, 0.4, 0.9]
    df = spark.createDataFrame([(299, 299), (None, 3)], "k long, n long")
    assert df.select(stats.exact_lower_bound("k", "n")).collect()[1][0] is None


def test_certified_threshold_against_brute_force(spark):
    rows = [(f"g{i % 9}", i / 50, i > 10 or i % 2 == 0) for i in range(50)]
    got = evaluation.certify_threshold(spark.createDataFrame(rows, "grp string, score double, positive boolean"), 0.6).collect()
    best = None
    for t in sorted({s for _, s, _ in rows}, reverse=True):
        groups = {}
        for g, s, p in rows:
            if s >= t:
                groups[g] = groups.get(g, True) and p
        if stats.lower_bound(sum(groups.values()), len(groups)) >= 0.6:
            best = t
    assert [r["threshold"] for r in got] == ([best] if best is not None else [])


def test_reexports_and_inheritance(spark):
    req = spark.createDataFrame([(1, "a", "f"), (2, "a", "g"), (3, "loop", "x"), (4, "a", "h")], "site_id long, module string, name string")
    direct = spark.createDataFrame([("c", "f0"), ("b", "g"), ("c", "g")], "module string, name string")
    fwd = spark.createDataFrame([("a", "f", "b", "f"), ("b", "f", "c", "f0"), ("a", "g", "b", "g"), ("a", "g", "c", "g"), ("loop", "x", "loop2", "x"), ("loop2", "x", "loop", "x")], "module string, name string, to_module string, to_name string")
    got = {r["site_id"]: (r["module"], r["hops"]) for r in resolution.reexport_trace(req, direct, fwd).collect()}
    assert got == {1: ("c", 2), 2: (None, None), 3: (None, None), 4: (None, None)}
    want = spark.createDataFrame([(1, "A", "m"), (2, "A", "s"), (3, "X", "m")], "site_id long, cls string, member string")
    mem = spark.createDataFrame([("B", "m", False), ("B", "s", True)], "cls string, member string, is_static boolean")
    ext = spark.createDataFrame([("A", "B"), ("X", "Y"), ("Y", "X")], "cls string, base string")
    got = {r["site_id"]: r["cls"] for r in resolution.inherited_member(want, mem, ext).collect()}
    assert got == {1: "B", 2: None, 3: None}


def test_funnel_and_api(spark):
    f = spark.createDataFrame([("a.ts", "x", 1), ("b", "#!/usr/bin/env node\n", 2), ("c.zip", "x", 1), ("d.py", "a\0b", 1), ("e.go", None, 1), ("f.go", "x", 9_999_999), ("g", "x", 1)], "path string, text string, size long")
    got = [r[0] for r in f.select(discovery.funnel_reason(F.col("path"), F.col("text"), F.col("size"))).collect()]
    assert got == [None, None, "unsupported-extension", "binary", "unreadable", "too-large", "no-extension"]
    s = spark.createDataFrame([(1, '{"swagger":"2.0","basePath":"/v1","paths":{"/x":{"get":{},"x-note":"y"}}}'), (2, '{"a":1}'), (3, "broken")], "spec_id int, json string")
    assert [tuple(r) for r in discovery.api_endpoints(s).collect()] == [(1, "/v1/x", "get")]


def test_snapshot_and_cards_round_trip(spark, tmp_path):
    n = spark.createDataFrame([("a", "A\n", None, "file", "x")], snapshot.NODES)
    li = spark.createDataFrame([("a", "b", "calls")], snapshot.LINKS)
    snapshot.write_snapshot(n, li, f"file://{tmp_path}/s")
    n2, l2 = snapshot.read_snapshot(spark, f"file://{tmp_path}/s")
    assert n2.collect() == n.collect() and l2.collect() == li.collect()
    d = spark.createDataFrame([("h", "t: \"q\"", "decision", ["c1"], "body\n---\nmore"), ("i", None, None, None, None)], "content_hash string, title string, node_type string, commits array<string>, content string")
    back = {r["content_hash"]: (r["title"], r["commits"], r["content"]) for r in snapshot.parse_cards(snapshot.render_cards(d)).collect()}
    assert back == {"h": ('t: "q"', ["c1"], "body\n---\nmore"), "i": (None, None, "")}
    (tmp_path / "bad.json").write_text('{"k":"1"}\nbroken\n')
    schema = snapshot.T.StructType([snapshot.T.StructField("k", snapshot.T.StringType())])
    assert snapshot.read_all_or_nothing(spark, f"file://{tmp_path}/bad.json", schema, "k").count() == 0


def test_prefix_budget_stops_at_first_overflow(spark):
    rows = [("g", 1, "node", "a", 3.0, "x" * 5), ("g", 2, "node", "b", 2.0, "x" * 90), ("g", 3, None, "c", 1.0, "x"), (None, 4, None, None, None, None), ("g", 5, "node", "z", 0.1, "")]
    p = spark.createDataFrame(rows, "grp string, id int, node_type string, title string, confidence double, text string")
    got = {r["id"]: (r["size"], r["kept"]) for r in maintenance.budget_prefix(p, most=60, least_confidence=0.5).collect()}
    assert got == {1: (16, True), 2: (101, False), 3: (12, False), 4: (10, True)}  # "- [node] a: xxxxx" has 16 characters


def test_cases_of_text_rules(spark):
    one = lambda value, f: spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).first()["x"]
    kept = {"feat: add it": False, "feat(core)!: add the whole thing": True, "add some cache": True, "docs: explain the whole thing": False, "tests: explain the whole thing": True, "Lint everything in the tree": False,
            "short": False, "bump the version of things": True, "fix: x\nlong body of the message": False, "": False}
    assert {m: one(m, text.worth_reading) for m in kept} == kept
    domains = {"src/auth/x.ts": "auth", "packages/cli/src/mcp/a.ts": "cli", "core/src/ingestion/a.ts": "core", "README.md": None, ".github/x.yml": None, "docs/a/b.md": None, "lib/x.ts": None, "src/a.ts": None, "tools/x.ts": "tools"}
    assert {p: one(p, text.domain) for p in domains} == domains
    assert one("show me who can call Foo.bar and foo.bar, was it?", text.keywords) == ["call", "Foo.bar", "foo.bar", "was"]


def test_trust_and_alternatives(spark):
    rows = [
        (1, "proven", "t", False, "none", None, True), (2, "proven", "t", False, "contradicted", "u", False), (3, "likely", "t", False, "none", None, False), (4, "likely", "t", False, "verified", "t", True),
        (5, "likely", "t", False, "verified", "u", False), (6, "proven", "t", True, "verified", "t", False), (7, "ambiguous", None, None, None, None, False),
    ]
    df = spark.createDataFrame(rows, "id int, cls string, selected string, stale boolean, verification string, verified string, want boolean")
    got = df.select("want", resolution.trusted(df.cls, df.selected, df.stale, df.verification, df.verified).alias("ok")).collect()
    assert all(r["ok"] == r["want"] for r in got)
    c = spark.createDataFrame([([(2, "c"), (0, "a"), (1, "b"), (3, "d")],)], "c array<struct<ordinal:int,target:string>>")
    pick = lambda cls, stale=False: tuple(c.select(*resolution.alternatives(c.c, F.lit("a"), F.lit(cls), F.lit(stale))).first())
    assert pick("likely") == (["b", "c"], []) and pick("ambiguous") == ([], ["a", "b", "c"]) and pick("proven") == ([], []) and pick("likely", True) == ([], [])


def test_queue_order_by_urgency(spark):
    q = spark.createDataFrame([("b", "s1", 0), ("a", "s1", 1), ("c", "s1", 2), ("none", "s1", 3), ("a", "s0", 4)], "file string, commit_sha string, idx int")
    r = [("a", "proven", False, None, "z"), ("b", "likely", False, None, "y"), ("b", "proven", False, None, "x"), ("c", "proven", True, None, "k")]
    got = maintenance.queue_order(q, spark.createDataFrame(r, "file string, cls string, stale boolean, verification string, signature string"))
    assert [r["idx"] for r in got.orderBy("position").collect()] == [3, 2, 0, 4, 1]


def test_ordinals_by_ranges_and_one_class_models(spark):
    df = spark.range(500).selectExpr("(id * 7919) % 500 AS k", "id AS extra")
    assert [r["k"] for r in maintenance.numbered(df, ["k"]).orderBy("position").collect()] == list(range(500))
    assert maintenance.numbered(df.limit(0), ["k"]).count() == 0
    rows = spark.createDataFrame([("m", 0.1, False), ("m", 0.9, True), ("n", 0.4, True), ("n", 0.5, True)], "model string, score double, positive boolean")
    assert {(r["model"], r["fitted"] is None) for r in evaluation.isotonic_fit(rows, "model").collect()} == {("m", False), ("n", True)}


def test_records_of_odd_rows(spark):
    nodes = spark.createDataFrame([("a", '["x","y"]', 1), ("b", "[bad", 1), ("c", None, 1), ("d", '["z#1"]', 1), (None, '["x"]', 1)], "node_key string, patterns string, path int")
    active = spark.createDataFrame([("x",), ("z#1",), (None,)], "path string")
    assert {r[0] for r in records.nodes_for_files(nodes, active).collect()} == {"a", "d", None}
    assert {r[0] for r in records.stale_nodes(nodes.where("node_key IS NOT NULL"), active).collect()} == {"b", "c"}
    keys = spark.createDataFrame([("z#1#f",), ("z#2",), ("x",), (None,)], "node_key string")
    assert {r[0] for r in records.key_in_files(keys, active).collect()} == {"z#1#f", "x"}
    spans = spark.createDataFrame([("p", "o", 1, 9), ("p", "i", 2, 4), ("p", "j", 2, 4), ("q", "i", 2, 4)], "path string, symbol string, start_line int, end_line int")
    assert {(r["path"], r["symbol"]): r["parent"] for r in records.lexical_parents(spans).collect()} == {("p", "o"): None, ("p", "i"): "o", ("p", "j"): "o", ("q", "i"): None}
    assert context.normal_limit(-1) == context.normal_limit(2.5) == context.normal_limit(None) == 10 and context.normal_limit(3) == 3


def test_registry_is_complete():
    from gneiss.plans import registry

    assert set(registry.ORACLE) <= set(registry.QUERIES) and len(registry.QUERIES) > 90


def test_stream_batches_are_published_once(spark, tmp_path):
    from gneiss.sources.versioned import VersionedTable
    from gneiss.streaming import deltas

    t = VersionedTable(spark, f"file://{tmp_path}/t", spark.range(1).schema)
    run = deltas.append_batches(t, "s", lambda df: df)
    run(spark.range(3), 0)
    run(spark.range(3), 0)
    run(spark.range(3, 5), 1)
    assert t.read().count() == 5


def test_name_candidates_without_pairs_of_sites_and_symbols(spark):
    """Equal to all pairs on files that hold many symbols of a name, call and import some; shared lists leave few rows."""
    import random

    r, limit = random.Random(3), 4
    symbols = [(f"k{i:03}", f"n{r.randrange(4)}", f"f{min(r.randrange(8), r.randrange(8))}") for i in range(150)] + [("k001", "n1", "f7"), ("k001", "n1", "f7"), ("z", None, "f1"), ("y", "n1", None)]
    sites = [(i, f"f{r.randrange(9)}", f"n{r.randrange(5)}") for i in range(120)] + [(5, "f1", "n1"), (6, "f2", "n2"), (6, "f2", "n2"), (200, None, "n1"), (201, "f1", None)]
    calls = [(f"f{r.randrange(9)}", r.choice(symbols)[0]) for _ in range(60)] + [("f3", s[0]) for s in symbols[:40]]
    imports = [(f"f{r.randrange(9)}", f"f{r.randrange(8)}") for _ in range(12)]
    per: dict[int, list] = {}
    for site, file, callee in sites:
        for key, name, path in symbols:
            if callee is not None and callee == name and None not in (file, path) and path != file:
                per.setdefault(site, []).append((0 if (file, key) in calls else 1 if (file, path) in imports else 2, key))
    want = sorted((site, key, o, len(c) > limit) for site, c in per.items() for o, (_, key) in enumerate(sorted(c)[:limit]))
    frame = lambda rows, cols: spark.createDataFrame(rows, cols)
    out = lambda s: resolution.name_candidates(
        frame(s, "site_id int, file_path string, callee string"), frame(symbols, "symbol_key string, name string, path string"),
        frame(calls, "file_path string, target_key string"), frame(imports, "file_path string, imported string"), limit,
    )
    assert sorted(map(tuple, out(sites).collect())) == want
    # 3,000 sites of one name: no join puts out a row for each pair of a site and a symbol
    many = out([(i, "f0", "n0") for i in range(3000)])
    many.collect()
    assert max(joined(many)) <= 2 * 3000 < 3000 * sum(n == "n0" and p != "f0" for _, n, p in symbols)


def joined(df):
    """Rows that each join of a DataFrame put out when it was collected."""
    out, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        if "Join" in kind and p.metrics().contains("numOutputRows"):
            out.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_validity_does_not_broadcast_lines(spark):
    """Lines exploded from a small table are joined by sorting, whatever size the planner assumes; results as before."""
    files = spark.range(20).select(F.col("id").cast("int").alias("path"))
    owners = files.select("path", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("line")).withColumn("owner", F.when(F.col("line") == 7, 9).otherwise(F.col("path") % 3))
    ranges = spark.createDataFrame([(1, 4, 0, 3, 1), (2, 4, 5, 8, 1), (3, 5, 0, 3, 1), (4, 99, 0, 3, 1), (5, 7, 0, 2, 1), (5, 7, 6, 7, 1), (6, 4, 0, 3, 1), (8, 4, 7, 7, 9)], "decision_id int, path int, start_line int, end_line int, commit int")
    decisions = spark.createDataFrame([(i, "garbage" if i == 6 else "pending") for i in range(1, 9)], "decision_id int, status string")
    out = maintenance.validity(decisions, ranges, owners)
    assert {r.decision_id: r.status for r in out.collect()} == {1: "active", 2: "garbage", 3: "garbage", 4: "pending", 5: "garbage", 6: "garbage", 7: "pending", 8: "active"}
    lines = maintenance.validity(decisions, ranges, owners)._jdf.queryExecution().sparkPlan().toString()
    assert "Generate explode" in lines and "SortMergeJoin [path" in lines


def test_closure_keeps_no_pairs(spark, monkeypatch):
    """Three full layers of 40 with a cycle and a null end; only edges and keys are written, blocks are divided."""
    import glob

    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from gneiss import storage
    from gneiss.operators import reach

    layer = lambda k: [f"{k}{i:02}" for i in range(40)]
    rows = [*((a, b, "calls") for k, m in ("ab", "bc") for a in layer(k) for b in layer(m)), ("c00", "d", "calls"), ("d", "c00", "calls"), ("a00", None, "calls")]
    li = spark.createDataFrame(rows, "src string, dst string, link_type string")
    every = spark.createDataFrame([(x,) for x in [*layer("a"), *layer("b"), *layer("c"), "d"]], "node_key string")
    at = storage.shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{at}/gneiss-closure-*"))
    out = impact.closure(li, every)
    got = {(r["start"], r["node"]): r["hops"] for r in out.collect()}
    want: dict = {}
    to: dict = {}
    for a, b, _ in rows:
        to.setdefault(a, set()).add(b)
    for (s,) in every.collect():
        front, h = {s}, 0
        while front:
            want |= {(s, x): h for x in front}
            front, h = {y for x in front for y in to.get(x, ())} - {x for t, x in want if t == s}, h + 1
    assert got == want and out.count() == len(want)
    kept = [sum(pq.read_metadata(f).num_rows for f in glob.glob(f"{d}/*/*.parquet")) for d in set(glob.glob(f"{at}/gneiss-closure-*")) - before]
    assert len(kept) == 1 and kept[0] < len(rows) + 3 * 122 < len(want)

    # a chain of numbers with a loop; with two pairs at most, the block is divided down to single starts
    class Chain:
        def over(self, wanted):
            yield slice(0, len(wanted)), pa.table({"s": [1, 2, 3, 3], "d": [2, 3, 3, 1]})

    monkeypatch.setattr(reach, "PAIRS", 2)
    parts = [(a + (p >> reach.BITS), p & reach.NODE, h) for a, p, h in reach.walk(np.array([1, 2, 3, 4]), Chain())]
    found = sorted(tuple(map(int, x)) for part in parts for x in zip(*part))
    assert found == [(0, 1, 0), (0, 2, 1), (0, 3, 2), (1, 1, 2), (1, 2, 0), (1, 3, 1), (2, 1, 1), (2, 2, 2), (2, 3, 0), (3, 4, 0)]
