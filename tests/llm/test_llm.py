import random

import pyarrow as pa
import pytest

from gneiss.llm import encode, grammar, handmade, leaks, overlap, productions, splits, subjects, syntax

SAMPLE = "sample_id string, repo_id string, repo_family string, duplicate_group string, split string, code_language string, fragment string, extra int"


def sample(i, repo=None, fam=None, dup=None, split="train", code=None, lang="python"):
    return (i, repo, fam, dup, split, lang, code, 1)


def test_family_pairs_and_splits(spark):
    rows = [
        sample("1", "h/a/x", "https://h.example/A/x.git", "D1"), sample("2", "h/b/y", " git@h.example:B/y/ ", "d1"), sample("2", "h/b/y", "b/y", "d1"),
        sample("3", "h/b/y", None, None), sample("4", "h/b/y", "c/z", "unknown"), sample("5", None, "e/e", "0000"), sample("6", None, "f/f", "0000"),
        sample("7"), sample(None, "h/a/x", "g/g", None), sample("8", "n/a", "h/h", ""),
    ]
    df = spark.createDataFrame(rows, SAMPLE)
    assert {tuple(r) for r in splits.family_pairs(df).collect()} == {("a/x", "b/y"), ("a/x", "c/z"), ("b/y", "c/z")}
    got = {r["sample_id"]: r for r in splits.assign_splits(df).collect()}
    assert set(got) == set("12345678") and len({got[i]["split"] for i in "1234"}) == 1
    assert tuple(splits.invariants(df).first()) == (8, 0, True)
    assert splits.assign_splits(df.limit(0)).count() == 0


def test_annealing_reaches_the_proportions(spark):
    rng = random.Random(1)
    rows = [sample(f"{f}-{i}", None, f"o/{f}", None, lang=rng.choice(["go", "c"])) for f in range(120) for i in range(rng.randrange(1, 30))]
    got = splits.assign_splits(spark.createDataFrame(rows, SAMPLE))
    n = {r["split"]: r["n_samples"] for r in splits.split_sizes(got).collect()}
    for s, p in splits.PROPORTIONS.items():
        assert abs(n[s] / len(rows) - p) < 0.01
    assert got.groupBy("component").agg({"split": "count"}).count() == got.select("component", "split").distinct().count()


def test_sizes_come_before_labels_and_no_label_is_lost(spark):
    sizes = {"a": 50, "b": 30, "c": 25, "d": 20, "e": 15, "f": 10}
    rows = [sample(f"{f}{i}", None, f"o/{f}", None, lang=f"lang{f}{i}") for f, n in sizes.items() for i in range(n)]
    got = splits.assign_splits(spark.createDataFrame(rows, SAMPLE), {"x": 0.5, "y": 0.3, "z": 0.2})
    assert {r["split"]: r["n_samples"] for r in splits.split_sizes(got).collect()} == {"x": 75, "y": 45, "z": 30}


def test_family_pairs_read_the_samples_once_and_plan_little(spark, tmp_path_factory):
    at = f"{tmp_path_factory.mktemp('s')}/t"  # short, as plans cut long names
    spark.createDataFrame([sample("1", "h/a/x", "a/x", "d1"), sample("2", "h/b/y", "b/y", "d1"), sample("3", "h/b/y", "c/z")], SAMPLE).write.parquet(at)
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    known = store.executionsList()
    last = max(known.apply(i).executionId() for i in range(known.size()))
    assert {tuple(r) for r in splits.family_pairs(spark.read.parquet(at)).collect()} == {("a/x", "b/y"), ("a/x", "c/z"), ("b/y", "c/z")}
    bus.waitUntilEmpty(30_000)
    ran = store.executionsList()
    plans = [x.physicalPlanDescription() for x in map(ran.apply, range(ran.size())) if x.executionId() > last]
    assert plans and sum(p.count(f"[file:{at}]") for p in plans) == 1
    assert max(map(len, plans)) < 50_000


CODE = "def f(a, b):\n    total = a.first(b) + other(a)\n    for x in total.items():\n        log.write(x, 'one', 17)\n    if total > b:\n        return finish(total, b)\n    return a.second(total)\n"


def test_overlap(spark):
    other = "def g(q):\n    w = q.load('z')\n    w.store(q)\n    while w.more():\n        push(w.next(), 4)\n    return done(w)\n"
    rows = [
        sample("t1", code=CODE), sample("e1", split=" Test", code="# note\n" + CODE.replace("    ", "  ")), sample("e2", split="calibration", code=CODE.replace("total", "amount").replace("17", "18")),
        sample("e3", split="test", code=other), sample("t2", code=None), sample("t3", code=""), sample("e4", split="temporal", code="x"), sample("t4", code="x"), sample("e1", split=" Test", code=CODE), sample("n", split=None, code=CODE),
    ]
    df = spark.createDataFrame(rows, SAMPLE)
    assert {(r[0], r[1]) for r in overlap.sample_pairs(df).collect()} == {("e1", "t1"), ("e2", "t1")}
    rep = {r["split"]: (r["n_samples"], r["n_exact"], r["n_near"]) for r in overlap.overlap_report(df).collect()}
    assert rep == {"test": (2, 1, 0), "calibration": (1, 0, 1)}
    assert overlap.sample_pairs(df.limit(0)).count() == 0


def gram_set(seq):
    return set(overlap.grams([seq])[0].tolist())


def nearly(toks, side, a, b):
    e, t = (gram_set(toks[x]) for x in ((a, b) if side[a] != "train" else (b, a)))
    close = len(e & t) >= -(-round(len(e) * overlap.LEAST, 6) // 1) and max(len(e), len(t)) <= overlap.RATIO * min(len(e), len(t))
    return toks[a] == toks[b] or close and overlap.near(toks[a], toks[b]) >= overlap.NEAR


def test_grams_of_batches():
    rng = random.Random(3)
    seqs = [[rng.choice(["a", "b1", "(", ")", ".", "if", "7", "'s'", ";"]) for _ in range(rng.randrange(0, 30))] for _ in range(60)]
    g, o = overlap.grams(seqs)
    for i, s in enumerate(seqs):
        one = overlap.grams([s])[0].tolist()
        assert sorted(one) == one and g[o == i].tolist() == one and len(set(one)) == len(one) >= 1
    assert gram_set("x = a . f ( 1 )".split()) == gram_set("y = b . f ( 2 )".split()) != gram_set("y = b . g ( 2 )".split())
    assert len(overlap.grams([])[0]) == 0


def test_contained_records(spark):
    rng = random.Random(9)
    line = lambda i: f"v{i} = obj{rng.randrange(99)}.call{rng.randrange(999)}(arg{i}, {i})"
    short = "\n".join(line(i) for i in range(8))
    rows = [sample("e1", split="test", code=short), sample("e2", split="test", code="\n".join(line(i) for i in range(8)))]
    rows += [sample(f"t{k}", code="\n".join([*(line(i) for i in range(60)), short, *(line(i) for i in range(k, 30))])) for k in range(3)]
    df = spark.createDataFrame(rows, SAMPLE)
    got = {r["sample_id"]: (r["split"], r["n_records"]) for r in overlap.contained_records(df).collect()}
    assert got == {"e1": ("test", 3)}
    assert overlap.sample_pairs(df).count() == 0  # not the same code
    assert overlap.contained_records(df.limit(0)).count() == 0


def test_overlap_matches_brute_force_on_near_copies(spark):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(40)]

    def fragment():
        return [f"{rng.choice(names)} = obj{rng.randrange(9)}.{rng.choice(names)}{rng.randrange(99)}({rng.choice(names)}, {rng.randrange(50)})" for _ in range(9)]

    rows, base = [], [fragment() for _ in range(12)]
    for k in range(60):
        f = list(rng.choice(base)) if k % 2 else fragment()
        if k % 3 == 0:
            f[rng.randrange(9)] = fragment()[0]
        rows.append(sample(f"s{k:02}", split=rng.choice(["train", "test"]), code="\n".join(f)))
    toks = {r[0]: overlap.tokens(r[6], "python") for r in rows}
    side = {r[0]: r[4] for r in rows}
    want = {(a, b) for a in toks for b in toks if a < b and side[a] != side[b] and nearly(toks, side, a, b)}
    assert len(want) > 15
    assert {(r[0], r[1]) for r in overlap.sample_pairs(spark.createDataFrame(rows, SAMPLE)).collect()} == want


def test_overlap_finds_every_pair_of_a_hot_group(spark):
    rng = random.Random(7)
    base = [f"v{i} = obj{i % 7}.call{i}(arg{i}, {i})" for i in range(27)]

    def variant(k):
        f = list(base)
        for at in rng.sample(range(9), 5):
            f[at] = f[at].replace(".call", f".own{k}x")
        return "\n".join(f)

    rows = [sample(f"s{k:03}", split="test" if k % 4 == 0 else "train", code=variant(k)) for k in range(400)]
    toks = {r[0]: overlap.tokens(r[6], "python") for r in rows}
    side = {r[0]: r[4] for r in rows}
    grams = {i: gram_set(t) for i, t in toks.items()}
    least = {i: -(-round(len(g) * overlap.LEAST, 6) // 1) for i, g in grams.items()}
    want = {tuple(sorted((a, b))) for a in toks for b in toks if side[a] == "test" != side[b] and len(grams[a] & grams[b]) >= least[a] and overlap.near(toks[a], toks[b]) >= overlap.NEAR}
    assert len(want) == 100 * 300
    assert {(r[0], r[1]) for r in overlap.sample_pairs(spark.createDataFrame(rows, SAMPLE)).collect()} == want


GOOD = {
    "javascript": "import a from 'x';\nconst f = async (x) => { return x?.y ?? [1, ...x]; }\nclass A extends B { #p = 1; static m(a, {b} = {}) { if (a) b(); else { this.p++ } } }\nfor (const k of f(1)) console.log(`a${k}`)\nexport default A;\n// } stray\n",
    "typescript": "import type { T } from './t';\nexport interface I<K> { a?: string; m(x: number): Map<string, K[]> }\nexport function f<T>(a: T, b?: readonly string[]): boolean { const x = a as unknown; return b!.length > 1; }\nenum E { A, B = 2 }\n",
    "java": "package a.b;\nimport java.util.*;\n@Deprecated\npublic final class A<T> extends B implements C {\n private final Map<String, List<T>> m = new HashMap<>();\n public A(int x) throws E { super(x); for (int i = 0; i < x; i++) { m.put(\"a\", null); } for (var q : m.keySet()) { int[] z = {1, 2}; } }\n int f() { return a ? b.c(d -> d + 1) : (int) e[0]; }\n}\n",
    "csharp": "using System;\nnamespace A.B {\n public sealed class C : D {\n  private readonly int _x = 3;\n  public string Name { get; set; } = \"q\";\n  public int F(IReadOnlyList<string> a, bool b) => a.Count;\n  void G() { foreach (var k in list) { if (k is null) return; } var s = $\"{k}\"; }\n }\n}\n",
    "c": "#include <stdio.h>\nstruct s { int a; char *b; };\nstatic int f(const struct s *p, size_t n)\n{\n  for (int i = 0; i < 3; i++) { if (p->a > 1 && n != 2) g(&p[i]); else return (int) n; }\n  int x[] = {1, 2};\n  return 0;\n}\n",
    "go": "package a\n\nimport (\n\t\"fmt\"\n)\n\ntype T struct {\n\ta int\n\tb map[string][]int\n}\n\nfunc (t *T) F(x int, y ...string) (int, error) {\n\tfor i, v := range y {\n\t\tif v == \"\" {\n\t\t\tcontinue\n\t\t}\n\t\tfmt.Println(i, T{a: 1})\n\t}\n\treturn x, nil\n}\n",
    "rust": "use std::collections::HashMap;\n#[derive(Debug)]\npub struct S<'a> { a: &'a str, b: Vec<HashMap<String, usize>> }\nimpl<'a> S<'a> {\n pub fn f(&self, x: Option<u8>) -> Result<String, E> {\n  let y = match x { Some(v) if v > 1 => v as usize, None => 0, _ => { 3 } };\n  for i in 0..y { println!(\"{}\", i); }\n  Ok(format!(\"{}\", y))\n }\n}\n",
    "python": "import os\n\n\n@dec(1)\nclass A(B):\n    \"\"\"doc {\"\"\"\n\n    def f(self, a: int, *b, c=3, **d) -> dict[str, int]:\n        x = [i for i in a if i > 1]\n        if not x and a is not None:\n            return {\n                'k': x[1:2],\n            }\n        elif c: pass\n        try:\n            y = lambda q: q + 1\n        except (E, F) as e:\n            raise G from e\n        return x, y\n",
}


@pytest.mark.parametrize("lang", sorted(GOOD))
def test_syntax_by_language(lang):
    permitted, reducer = productions.pairs(lang), productions.Reducer(lang)

    def bad(code):
        s = grammar.classes(code, lang)
        return [a + b for a, b in zip("^" + s, s + "$") if a + b not in permitted] + ([] if reducer.valid(s) else ["fits"])

    assert bad(GOOD[lang]) == []
    assert bad(GOOD[lang].replace("\n", "\r\n")) == [] and bad("\ufeff" + GOOD[lang]) == []
    lines = GOOD[lang].split("\n")
    cut = "\n".join(lines[: len(lines) // 2]) + "\nfoo(bar("
    assert bad(cut)
    conflict = "\n".join([*lines[:3], "<<<<<<< HEAD", lines[3], "=======", lines[3], ">>>>>>> x", *lines[4:]])
    assert bad(conflict)
    for foreign in ("The quick fox jumps over the lazy dog and runs away.\n", "<!DOCTYPE html>\n<p class=\"a\">x</p>\n", "version: 2\nsome-key:\n  image: a/b:1.2\n"):
        assert bad(foreign), foreign


FILES = "task_id string, repo_id string, file_path string, code string, code_language string, pairs int"


def test_broken_files(spark):
    rows = [
        ("1", "r", "a.py", GOOD["python"], " PY ", 1), ("2", "r", "a.py", "def f(:\n", None, 1), ("2", "r", "a.py", "def f(:\n", None, 1), ("3", "r", "a.go", None, "go", 1), ("4", "r", "a.go", "", "go", 1),
        ("5", "r", "b.zzz", "((", None, 1), ("6", "r", "c.js", GOOD["typescript"], "javascript", 1), ("7", "r", "c.ts", GOOD["javascript"], None, 1), ("8", "r", "x", "x = [" + "1, " * 60000 + "2]\n", "python", 1), (None, "r", "x.py", "((", "py", 1),
    ]
    df = spark.createDataFrame(rows, FILES)
    assert {r["task_id"]: r["rule"] for r in syntax.broken_files(df).collect()} == {"2": "pairs", "6": "pairs"}
    nested = spark.createDataFrame([(str(i), c) for i, c in enumerate(["(a)[b]{}", "(]", "(", ")", "", "([)]", "x" * 9, "(" * 3000 + ")" * 3000])], "i string, c string")
    assert [r[0] for r in nested.orderBy("i").select(syntax.unclosed(nested.c)).collect()] == [False, True, True, True, False, True, False, False]
    rates = {(r["language"]): (r["n_files"], r["n_broken"]) for r in syntax.broken_rates(df).collect()}
    assert rates == {"python": (3, 1), "javascript": (1, 1), "typescript": (1, 0)}
    assert syntax.broken_files(df.limit(0)).count() == 0


def test_handmade(spark):
    shapes = ["  const c{i} = a.step{i}(b, {i});", "  if (a.ready{i}(b)) {{\n    b.fire{i}();\n  }}", "  for (const k{i} of b.all()) {{\n    a.add(k{i}, 'z{i}');\n  }}", "  a += b[{i}];", "  return c{i}.join(a, b, 'k{i}');",
              "  while (b.more{i}()) {{\n    b.next(a).then(c => c.d{i});\n  }}", "  log{i}(a);", "  const [x{i}, y{i}] = b.pair();", "  delete a.b{i}.c;", "  a.q = b ? {i} : a;"]
    rng = random.Random(8)

    def code(name):
        body = lambda i: "\n".join(rng.choice(shapes).format(i=f"{name}{i}") for _ in range(5))
        return "\n\n".join(f"function {name}{i}(a, b) {{\n{body(i)}\n}}" for i in range(5))

    lib, mine = code("lib"), code("own")
    patched = lib.replace("function lib2(a, b) {", "function lib2(a, b) {\n  patched(a);")
    rows = [
        ("v1", "h/a/x", "src/util/l.js", lib, "js", 1), ("v2", "h/b/y", "lib/q/l.js", "// no notice\n" + patched, "js", 1), ("m", "h/a/x", "src/own.js", mine, "js", 1), ("m2", "h/a-1/x", "src/own.js", mine, "js", 1), ("m3", "h/a/x", "src/own.js", mine + "\n", "js", 1),
        ("g", "h/a/x", "src/g.go", "// Code generated by tool. DO NOT EDIT.\npackage a\n", "go", 1), ("s", "h/a/x", "src/s.js", mine + "\n\nemit('// Code generated by tool. DO NOT EDIT.');\n", "js", 1),
        ("d", "h/a/x", "src/d.py", "X = [\n" + "  1, 2, 3,\n" * 30 + "]\n", "python", 1), ("n", "h/a/x", "node_modules/z/i.js", mine[:80], "js", 1), ("i", "h/a/x", "src/vendors/bills/i.js", mine, "js", 1),
        ("min", "h/a/x", "web/q.js", "!function(a,b){" + "c=a||{},c.d=!0;" * 60 + "}(x,y)", "js", 1), ("e", None, None, None, None, 1), ("e2", None, "a", " ", "js", 1),
    ]
    df = spark.createDataFrame(rows, FILES)
    got = {r["task_id"]: r["reason"] for r in handmade.not_handwritten(df).collect()}
    assert got == {"v1": "vendored", "v2": "vendored", "g": "generated", "d": "data", "n": "vendored", "min": "minified"}
    assert handmade.not_handwritten(df.limit(0)).count() == 0


def test_headers_are_read_whole_and_calls_are_no_data():
    licence = "".join(f"// line {i} of a long licence text\n" for i in range(700))
    assert handmade.describe("a.go", licence + "// Code generated by tool. DO NOT EDIT.\npackage a\n", "go")[:2] == ("generated", "header")
    assert handmade.describe("a.go", licence + "package a\n// Code generated by tool. DO NOT EDIT.\n", "go")[0] == "generated"
    calls = "".join(f"  step{i}Of({'9, ' * i}'a rather long text of no use {i}');\n" for i in range(12))
    assert handmade.describe("a.js", "function f() {\n" + calls + "}\n", "javascript")[0] is None
    same = "".join(f"  add({i}, 'a rather long text of no use {i}');\n" for i in range(12))
    assert handmade.describe("a.js", same, "javascript")[0] == "data"
    for other in ('{\n  "a0": {\n    "b": 1,\n    "c": ["x", "y"]\n  }\n}\n', ".a-b {\n  margin: 3px;\n  color: #ff0011;\n}\n" * 9):
        assert handmade.describe("a.ts", other, "typescript")[0] is None


def test_deep_paths_and_rules(spark):
    deep = "/".join(f"d{i}" for i in range(3000))
    rows = [("a", deep + "/x.js", "1"), ("b", deep + "/x.js", "1"), ("a", "p/y.js", "2")]
    t = handmade.directory_hashes(spark.createDataFrame(rows, "repo string, file_path string, whole string"))
    assert t.where("repo = 'b'").count() == handmade.DEPTH - 1


def test_merkle_directories(spark):
    rows = [("a", "lib/p/x.js", "1"), ("a", "lib/p/y.js", "2"), ("b", "q/p/x.js", "1"), ("b", "q/p/y.js", "2"), ("b", "q/z.js", "3"), (None, "lib/p/x.js", "1")]
    t = {(r["repo"], r["dir"]): (r["tree"], r["n_files"]) for r in handmade.directory_hashes(spark.createDataFrame(rows, "repo string, file_path string, whole string")).collect()}
    assert t["a", "lib/p"] == t["b", "q/p"] and t["a", "lib"][0] != t["b", "q"][0] and t["b", "q"][1] == 3


def test_copies_of_whole_files_and_of_directories_of_one_revision(spark):
    header = (
        "#include <stddef.h>\n#define ZL_LIMIT 64\ntypedef struct zl zl_t;\nextern int zl_errors;\nzl_t *zl_open(const char *path);\nvoid zl_close(zl_t *z);\n"
        "int zl_read(zl_t *z);\nstruct zl_state;\n#undef zl_debug\nenum zl_mode;\n#if ZL_LIMIT > 32\n#pragma once\n#endif\n"
    )
    tiny = lambda i: f"export * from './m{i}';\n"
    whole = lambda i: handmade.describe("a.js", tiny(i), "javascript")[2]
    # the other revisions' contents have the smaller hashes
    other = lambda i, k: next(tiny(j) for j in range(k, k + 999) if whole(j) < whole(i))
    files = [
        ("h1", "h/a/x", "r1", "src/z/lib.h", header), ("o1", "h/a/x", "r1", "src/z/own.c", "int one(int a)\n{\n  return a + 1;\n}\n"),
        ("h2", "h/b/y", "r2", "inc/lib.h", header), ("o2", "h/b/y", "r2", "inc/own.c", "int two(int a)\n{\n  return a * 2;\n}\n"), ("s1", "h/a/x", "r1", "a/i.js", tiny(0)), ("s2", "h/b/y", "r2", "b/i.js", tiny(0)),
        *[(f"p{i}", "h/c/z", "r3", f"q/p/f{i}.js", tiny(i)) for i in (1, 2)], *[(f"q{i}", "h/c/z", "r4", f"q/p/f{i}.js", other(i, 1000 * i)) for i in (1, 2)],
        *[(f"u{i}", "h/d/w", "r5", f"k/p/f{i}.js", tiny(i)) for i in (1, 2)], *[(f"w{i}", "h/d/w", "r6", f"k/p/f{i}.js", other(i, 5000 * i)) for i in (1, 2)],
    ]
    df = spark.createDataFrame([(t, r, v, p, c, None) for t, r, v, p, c in files], "task_id string, repo_id string, revision string, file_path string, code string, code_language string")
    assert {r["task_id"]: r["reason"] for r in handmade.not_handwritten(df).collect()} == {t: "vendored" for t in ("h1", "h2", "p1", "p2", "u1", "u2")}


def test_encoder_is_exact(spark):
    with open(encode.VOCABULARY, "rb") as f:
        enc = encode.Encoder(encode.read_ranks(f.read()))
    import tiktoken

    ref = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=enc.ids, special_tokens={})
    rng = random.Random(2)
    bits = ["a", "b", " ", "  ", "the", "ing", "'s", "\n", "é", "日本", "\x1c", "\u200b", "AAAA", "0", "_-", "<|endoftext|>", "🚀", "\r\n"]
    for _ in range(500):
        s = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        assert enc.encode(s) == ref.encode_ordinary(s) and enc.decode(enc.encode(s)) == s
    def merged(b):
        p = [bytes([x]) for x in b]
        while len(p) > 1:
            r, i = min((enc.ids.get(p[i] + p[i + 1], 1 << 30), i) for i in range(len(p) - 1))
            if r == 1 << 30:
                break
            p[i : i + 2] = [p[i] + p[i + 1]]
        return tuple(enc.ids[x] for x in p)
    for _ in range(300):
        b = "".join(rng.choice("abcdeilnorst  ") for _ in range(rng.randrange(1, 60))).encode()
        assert enc._backtrack(b) == merged(b)
    df = spark.createDataFrame([(1, "a b", 7), (2, None, 7), (3, "", 7), (1, "a b", 7)], "doc_id long, text string, ids int")
    got = sorted((r["doc_id"], r["ids"]) for r in encode.encode_corpus(df).collect())
    assert got == [(1, enc.encode("a b")), (1, enc.encode("a b")), (2, []), (3, [])]
    assert encode.encode_corpus(df.limit(0)).count() == 0
    assert enc.encode("x " * 200_000) == ref.encode_ordinary("x " * 200_000)


def test_leaks(spark):
    rng = random.Random(4)
    items = [(i, "s", "test", " ".join(f"W{rng.randrange(300)}," for _ in range(50))) for i in range(8)] + [(99, "s", "test", None), (98, "s", "test", "  ")]
    words = [t[3].replace(",", "").split() for t in items[:8]]
    noise = lambda: [f"z{rng.randrange(500)}" for _ in range(30)]
    changed = words[1][10:35]
    changed[5], changed[13], changed[20] = "other", "single", "words"
    shuffled = words[2][:30]
    rng.shuffle(shuffled)
    docs = [
        (1, " ".join(noise() + words[0][5:28] + noise()).lower()), (2, "\n".join([*noise(), *changed])), (3, " ".join(shuffled)), (4, " ".join(words[3][:7])), (5, None), (6, ""),
        (7, " ".join(words[4] + noise() * 2000 + words[5])), (1, "again"), (8, " ".join(w.upper() + ";" for w in words[6])),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id")
    it = spark.createDataFrame(items, "item_id long, suite string, item_split string, text string")
    found = leaks.leaks(d, it)
    assert {(r[0], r[1]) for r in found.collect()} == {(1, 0), (2, 1), (7, 4), (7, 5), (8, 6)}
    assert {r["item_id"]: r["n_documents"] for r in leaks.leaked_items(found, it).collect()}[7] == 0
    assert leaks.leaks(d.limit(0), it).count() == 0 and leaks.leaks(d, it.limit(0)).count() == 0


def test_leaks_of_any_length(spark, monkeypatch):
    rng = random.Random(6)
    long = [f"w{rng.randrange(3000)}" for _ in range(900)]
    changed = [*long[:500], "other", *long[501:]]
    automaton = leaks.Automaton([long, ["single"], ["two", "words"], long[:10]])
    best = {i: c[0] for i, c in leaks.matches(automaton, ["pre", *changed, "single", "or", "two", "words"]).items()}
    assert best[0][:3] == (899, 0, 900) and best[0][3:] == (1, 901) and best[1][0] == 1 and best[2][0] == 2
    again = leaks.matches(automaton, [*long[100:140], *["zz"] * 50, *long[100:140]])[0]
    assert [c[3:] for c in again if c[0] == 40] == [(0, 40), (90, 130)]
    items = spark.createDataFrame([(i, "s", "t", " ".join(f"q{i}x{k}" for k in range(30))) for i in range(12)] + [(50, "s", "t", "lone")], "item_id long, suite string, item_split string, text string")
    text = lambda i: "Vor\u0301her: " + ", ".join(f"Q{i}X{k}" for k in range(30)) + "! nach\u00ad her"
    docs = spark.createDataFrame([(i, text(i)) for i in range(12)] + [(90, "one lone word"), (91, None), (92, "")], "doc_id long, text string")
    want = {(i, i) for i in range(12)} | {(90, 50)}
    assert {(r[0], r[1]) for r in leaks.leaks(docs, items).collect()} == want
    clean = {r["doc_id"]: (r["text"], r["n_spans"], r["removed_words"]) for r in leaks.without_leaks(docs, items).collect()}
    assert clean[3] == ("Vor\u0301her:  ! nach\u00ad her", 1, 30) and clean[90] == ("one   word", 1, 1) and clean[91] == (None, 0, 0) and clean[92] == ("", 0, 0)
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 100)
    assert {(r[0], r[1]) for r in leaks.leaks(docs, items).collect()} == want
    assert {r["doc_id"]: r["n_spans"] for r in leaks.without_leaks(docs, items).collect()} == {d: c[1] for d, c in clean.items()}


def test_growth_matches_brute_force(spark):
    rng = random.Random(11)
    rows = [([f"w{x}" for x in sorted(rng.sample(range(40), rng.randrange(2, 9)))], rng.choice("abc")) for _ in range(400)]
    rows = [(w, "a" if {"w1", "w2"} <= set(w) else area) for w, area in rows]
    rules, seen = subjects.mine(spark.createDataFrame(rows, "words array<string>, area string"), 4, 0.6)
    size = {a: sum(x == a for _, x in rows) for a in "abc"}
    count = lambda k, a: sum(set(k) <= set(w) and x == a for w, x in rows)
    assert ("w1", "w2") in rules and seen == {w for ws, _ in rows for w in ws}
    for k, (area, _) in rules.items():
        rates = {a: count(k, a) / size[a] for a in "abc"}
        assert area == max(rates, key=rates.get) and sum(count(k, a) for a in "abc") >= 4
        assert rates[area] / (sum(rates.values()) + 0.5 * 3 / 400) >= 0.6
    sure = lambda k: max(count(k, a) / size[a] for a in "abc") / (sum(count(k, a) / size[a] for a in "abc") + 0.5 * 3 / 400) >= 0.6
    assert {k for k in rules if len(k) == 1} == {(w,) for w in seen if sure((w,))}


def test_subjects(spark):
    rng = random.Random(7)
    vocabulary = {a: [f"{a}{x}" for x in ("alpha", "bravo", "carol", "delta", "elder", "fixed")] for a in ("sun", "sea", "law")}
    glue = ["the report lists", "nobody had checked", "users asked about", "we keep"]

    def line(a, known=6):
        return f"{rng.choice(glue)} {rng.choice(vocabulary[a][:known])} and {rng.choice(vocabulary[a])}."

    ex = spark.createDataFrame([(i, " ".join(line(a, 3) for _ in range(3)), a) for i in range(40) for a in vocabulary], "example_id long, text string, subject string")
    docs, want = [], set()
    for i in range(90):
        a, b = rng.sample(sorted(vocabulary), 2)
        mixed = i % 3 == 0
        docs.append((i, "s", "\n".join([line(a) for _ in range(5 if mixed else 8)] + [line(b) for _ in range(5 if mixed else 1)] + ["nothing else changes."])))
        want |= {(i, a)} | ({(i, b)} if mixed else set())
    docs += [(900, "s", None), (901, "s", " "), (902, "s", "4bf00 12aa9\n" * 5)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "1 AS share")
    got = {(r[0], r[1]) for r in subjects.document_areas(d, ex).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert subjects.document_areas(d.limit(0), ex).count() == 0


def test_an_area_of_exactly_a_quarter_counts(spark):
    vocabulary = {a: [f"{a}{x}" for x in ("alpha", "bravo", "carol")] for a in ("sun", "sea", "law", "art")}
    line = lambda a, i: f"we keep {vocabulary[a][i % 3]} and {vocabulary[a][(i + 1) % 3]}."
    ex = spark.createDataFrame([(i, " ".join(line(a, k) for k in range(3)), a) for i in range(20) for a in vocabulary], "example_id long, text string, subject string")
    docs = [(i, "s", "\n".join(line(a, i + k) for k in range(8))) for i, a in enumerate(list(vocabulary) * 5)]
    docs += [(100, "s", "\n".join(line(a, 0) for a in vocabulary)), (101, "s", "\n".join([line("sun", i) for i in range(6)] + [line("sea", i) for i in range(2)]))]
    docs += [(102, "s", "\n".join([line("sun", i) for i in range(7)] + [line("sea", 0)]))]
    got = subjects.document_areas(spark.createDataFrame(docs, "doc_id long, source string, text string"), ex)
    assert {(r[0], r[1]) for r in got.where("doc_id >= 100").collect()} == {(100, a) for a in vocabulary} | {(101, "sun"), (101, "sea"), (102, "sun")}


def test_rules_come_from_all_documents(spark):
    # the word newcomer has just the support that a rule needs, and nothing else tells of the last document
    line = lambda a, *more: " ".join(["we", "keep", f"{a}alpha", f"{a}bravo", *more]) + "."
    ex = spark.createDataFrame([(i, " ".join([line(a)] * 3), a) for i in range(20) for a in ("sun", "sea")], "example_id long, text string, subject string")
    texts = ["\n".join([line("sun", "newcomer")] + [line("sun")] * 5)] * subjects.LEAST + ["\n".join([line(a)] * 6) for a in ("sun", *["sea"] * 3) for _ in range(6)]
    docs = [(50_000 + i, "s", t) for i, t in enumerate([*texts, "the newcomer stays.\nno newcomer left."])]
    blank = spark.range(40_000).selectExpr("id AS doc_id", "'s' AS source", "IF(id % 2 = 0, ' ', NULL) AS text")
    got = subjects.document_areas(spark.createDataFrame(docs, "doc_id long, source string, text string").union(blank), ex)
    assert {(r[0], r[1], r[2]) for r in got.where(f"doc_id = {docs[-1][0]}").collect()} == {(docs[-1][0], "sun", 1.0)}


def test_scores_of_a_batch_match_single_sentences():
    rng = random.Random(5)
    words = [f"w{x:02}" for x in range(30)]
    rules = {(w,): (rng.choice("abc"), round(rng.uniform(0.4, 3), 4)) for w in words[:20]}
    rules |= {tuple(sorted(rng.sample(words, 2))): (rng.choice("abc"), round(rng.uniform(0.4, 5), 1)) for _ in range(120)}
    lines = [sorted(rng.sample([*words, "x", "y"], rng.randrange(1, 12))) for _ in range(2000)]

    def plain(line):
        evidence, used = dict.fromkeys("abc", 0.0), set()
        for e, pair, area in sorted((-rules[p][1], p, rules[p][0]) for p in rules if len(p) == 2 and set(p) <= set(line)):
            if used.isdisjoint(pair):
                evidence[area] -= e
                used.update(pair)
        for w in line:
            if w not in used and (w,) in rules:
                evidence[rules[(w,)][0]] += rules[(w,)][1]
        (e, area), (second, _) = sorted(((e, a) for a, e in evidence.items()), key=lambda x: (-x[0], x[1]))[:2]
        return "abc".index(area) if e >= subjects.EVIDENCE and e - second > 0.4 else -1

    model = subjects.Model(rules)
    assert model.areas == list("abc")
    assert model.score(*subjects._flat(pa.array(lines))).tolist() == [plain(line) for line in lines]


def test_every_language_has_a_grammar():
    assert set(grammar.LANGUAGES.values()) == set(productions.RULES)
