import random

from gneiss.operators import hierarchy as h


def brute(edges):
    parent = {}
    for p, c in edges:
        parent[c] = min(p, parent.get(c, p))
    nodes = {x for e in edges for x in e}
    out = {}
    for n in nodes:
        seen, at = [n], n
        while at in parent and parent[at] not in seen:
            at = parent[at]
            seen.append(at)
        out[n] = ("cycle", -1) if at in parent else (at, len(seen) - 1)
    return out


def test_matches_brute_force(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(i)}", f"n{i}") for i in range(1, 60)]
    edges += [(f"d{i}", f"d{i + 1}") for i in range(70)]  # deep chain
    edges += [("x", "y"), ("y", "z"), ("z", "x"), ("z", "below"), ("self", "self"), ("x", "y")]
    edges += [("p1", "two"), ("p2", "two")]
    links = spark.createDataFrame(edges, "parent string, child string")
    got = {r[0]: (r[1], r[2]) for r in h.resolve(links).collect()}
    assert got == brute(edges)
    paths = {r["node_key"]: r for r in h.paths(links).collect()}
    assert paths["d70"]["path"].split(" > ") == [f"d{i}" for i in range(71)]
    assert paths["x"]["path"] is None and paths["x"]["n_descendants"] == -1
    assert paths["d0"]["n_descendants"] == 70
    pairs = {(r[0], r[1]): r[2] for r in h.descendants(links).collect()}
    assert pairs["d3", "d10"] == 7 and ("x", "y") not in pairs


def test_dirty_edges_and_empty_input(spark):
    rows = [("a", "b", " Contains "), ("a", None, "contains"), ("", "c", "contains"), ("a", "d", "calls"), (None, None, None), ("a", "b", "CONTAINS")]
    e = spark.createDataFrame(rows, "source_key string, target_key string, link_type string")
    e = e.selectExpr("*", "1 AS k1", "2 AS parent", "3 AS done")  # clashing names
    assert {tuple(r) for r in h.resolve(h.contains_edges(e)).collect()} == {("a", "a", 0), ("b", "a", 1)}
    assert h.resolve(h.contains_edges(e.limit(0))).count() == 0
    assert h.paths(h.contains_edges(e.limit(0))).count() == 0
