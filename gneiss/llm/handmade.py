"""Generated, minified and vendored files, and data saved as code.

A file is a small Merkle tree: its declarations (runs of lines between blank
lines or at the left margin, without comments and layout) are the leaves, their
hashes make the file's hash, and files make the hashes of directories, bottom-up
level by level, for each revision and over all revisions. A directory of two
files or more or a file of FILE words or more whose hash, or leaves of LEAF words
or more that make up SHARED of a file, occur in unrelated repositories mark
vendored code; so copies that were patched, stripped of their notice or cut short
are found by what is left of them. A copy that no other repository of the corpus
has is found by its path. Header rules (notices in the leading comments, however
long), rules on the path, and layout rules (line lengths, share of literals,
repeated line shapes) find generated and minified files and data.

Data saved as code is a table of literals in the file's language; a file that is
as a whole of another format under a wrong extension (JSON, style sheets) is no
source at all and a case of syntax.py.

Defined cases: null and blank code is hand-written (nothing to judge); repeated
rows count once; revisions of a file within one repository are no copies; a
repository and its forks (the same name under an owner that differs by a number)
are related; null repo_ids are related to nothing and mark nothing; of several
reasons the first by name counts, of several rules a Merkle one; very long files
are read whole; directories deeper than DEPTH are part of the one at DEPTH;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.syntax import language
from gneiss.storage import Scratch

SHARED = 0.5
LEAF = 12  # least words of a leaf that can mark a copy
FILE = 24  # least words of a whole file that can
MIN_REPOS = 2
DEPTH = 64  # levels of directories that are hashed one by one

# Notices of tools in the leading comments.
NOTICE = re.compile(
    r"code generated|generated (?:by|from|code|file|with|using)|auto-?\s?generated|automatically generated|machine[- ](?:written|generated|made)"
    r"|do not (?:edit|modify|change|make changes)|output of `|fichier produit par|ne pas (?:modifier|éditer)|produced by (?:a tool|the)|was (?:produced|created|written) by a tool|@generated|changes (?:to this file )?(?:will|may) be (?:lost|overwritten)"
    r"|source of truth is|wurde .{0,60}(?:erzeugt|generiert)|automatisch (?:erzeugt|generiert)|généré|automatiquement par|generado (?:por|automáticamente)|no (?:editar|modificar)|自動生成|编辑此文件|自动生成",
    re.I,
)
# Paths of third-party code, of generated files and of minified files.
VENDORED = re.compile(
    r"(?:^|/)(?:node_modules|bower_components|third[_-]?party|3rd[_-]?party|vendor|vendored|deps|external|externals|extern|contrib/lib|_vendor|site-packages|Godeps)/(?!.*\b(?:ours|internal)\b)", re.I
)
GENERATED = re.compile(
    r"(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:\.gw)?\.(?:go|cc|h|c)|_pb\.(?:js|d\.ts|ts)|OuterClass\.java|\.g\.cs|\.g\.i\.cs|\.designer\.cs|\.generated\.\w+|_generated\.\w+|\.gen\.\w+|_gen\.go|zz_generated\.\w+|_string\.go|\.min\.js|-min\.js|\.bundle\.js)$", re.I
)

_COMMENT = {
    True: re.compile(r"#[^\n]*|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''"),
    False: re.compile(r'("(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`)|/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*'),
}
_WORD = re.compile(r"[^\W\d]\w*|\d[\w.]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`|[^\s\w]")
_SHAPE = re.compile(r"[^\W\d]\w*|\d[\w.]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'")


def header(code: str) -> str:
    """The leading comments of a file."""
    m = re.match(
        r"(?:\ufeff|\s+|#![^\n]*|package [\w.]+;?|//[^\n]*|#[^\n]*|/\*[\s\S]*?\*/|--[^\n]*|\"\"\"[\s\S]*?\"\"\"|'use strict';|\"use strict\";)*+", code
    )
    return m[0] if m else ""


_OTHER = re.compile(r"\s*\{\s*\"[^\"\n]*\"\s*:|\s*(?:[.#@]?[\w][\w .#:>-]*\{\s*(?:[\w-]+:[^;{}\n]+;\s*)+\}\s*)+\Z")
_CALL = re.compile(r"^[ \t]*([\w.]+)\([^()\n]*\);?[ \t]*$", re.M)


def calls(body: str) -> int:
    """Lines that are calls, if they call several functions; a table made by calls of one is none."""
    found = Counter(_CALL.findall(body))
    n = sum(found.values())
    return n if len(found) > 3 and max(found.values()) < 0.5 * n else 0


def layout(body: str, words: list[str], python: bool) -> str | None:
    """minified, data or generated by the look of the code; None for code as people write it."""
    lines = [x for x in body.split("\n") if x.strip()]
    if not lines:
        return None
    size = sum(map(len, lines))
    if not words:
        return None
    longest = max(map(len, lines))
    spaces = body.count(" ") / max(1, len(body))
    names = [w for w in words if w[0].isalpha() or w[0] == "_"]
    ends = sum(("=" in x or "(" in x) if python else x.rstrip()[-1] in ";{}),(]" for x in lines)
    if size >= 300 and (size / len(lines) > 180 or longest > 500) and names:
        short = sum(len(w) <= 2 for w in names) / len(names)
        if short > 0.4 or spaces < 0.06:
            return "minified"
    if _OTHER.match(body):
        return None
    code_rows = calls(body)
    literals = sum(len(w) for w in words if w[0].isdigit() or w[0] in "\"'`" and len(w) > 1)
    named = sum(map(len, names))
    if len(words) >= 20 and literals > 0.6 * (literals + named) and code_rows < 0.25 * len(lines):
        return "data"
    rows = Counter(x.strip() for x in _SHAPE.sub("_", body).split("\n") if x.strip())
    open_rows = {s: n for s, n in rows.items() if len(s) > 2}
    n = sum(open_rows.values())
    if len(lines) >= 8 and n >= 6:
        literal_rows = sum(k for s, k in open_rows.items() if re.fullmatch(r"[\[\](){}<>,:;&_\s-]*|[{\[(]?(?:\s*_\s*[:=]\s*_,?)+\s*[}\])]?,?|(?:new )?_\([_, ]*\),?", s))
        if literal_rows - code_rows > 0.75 * n and literals > 0.25 * (literals + named):
            return "data"
        top = sum(k for _, k in Counter(open_rows).most_common(4))
        if len(open_rows) <= 0.3 * n and top >= 0.7 * n and n >= 10 and ends >= 0.4 * len(lines):
            return "generated"
    return None


def leaves(body: str) -> list[list[str]]:
    """Words of the declarations of a file without comments."""
    return [w for part in re.split(r"\n(?=[^\s)\]}])|\n\s*\n", body) if (w := _WORD.findall(part))]


def describe(path: str | None, code: str | None, lang: str | None) -> tuple[str | None, str, str, list[tuple[str, int]]]:
    """(reason by the file alone, rule that gave it, hash of the file, leaves)."""
    code = (code or "").replace("\r\n", "\n").replace("\r", "\n").lstrip("\ufeff")
    if not code.strip():
        return None, "", "", []
    python = lang == "python"
    body = _COMMENT[python].sub(lambda m: (m[1] or " ") if not python else " ", code)
    found = leaves(body)
    parts = [(hashlib.md5(" ".join(w).encode("utf-8", "surrogatepass")).hexdigest(), len(w)) for w in found]
    whole = hashlib.md5("".join(h for h, _ in parts).encode()).hexdigest() if parts else ""
    plain = re.sub(r"/+", "/", (path or "").strip().replace("\\", "/"))
    if NOTICE.search(header(code)):
        return "generated", "header", whole, parts
    if VENDORED.search(plain) or re.search(r"(?:^|/)[\w-]+-\d+\.\d+(?:\.\d+)?/", plain):
        return "vendored", "path", whole, parts
    if GENERATED.search(plain):
        return "minified" if re.search(r"min\.js$|bundle\.js$", plain, re.I) else "generated", "path", whole, parts
    return layout(body, [w for ws in found for w in ws], python), "layout", whole, parts


def unrelated(repo_id: Column) -> Column:
    """Name that a repository shares with its forks: owner without a number at the end, and name."""
    plain = F.regexp_replace(F.lower(F.trim(repo_id)), r"(/|\.git)+$", "")
    return F.regexp_replace(plain, r"-\d+(?=/[^/]+$)", "")


def _described(requests: DataFrame, scratch: Scratch) -> DataFrame:
    revision = F.lower(F.trim("revision")) if "revision" in requests.columns else F.lit(None).cast("string")
    rows = requests.where("task_id IS NOT NULL").select(
        "task_id", unrelated(F.col("repo_id")).alias("repo"), revision.alias("revision"), "file_path", language(F.col("code_language"), F.col("file_path")).alias("language"), "code"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [describe(p, c, g) for p, c, g in zip(b["file_path"], b["code"], b["language"])]
            yield pd.DataFrame(
                {
                    "task_id": b["task_id"], "repo": b["repo"], "revision": b["revision"], "file_path": b["file_path"], "reason": [g[0] for g in got], "rule": [g[1] for g in got],
                    "whole": [g[2] for g in got], "leaf": [[h for h, _ in g[3]] for g in got], "words": [[n for _, n in g[3]] for g in got],
                }
            )

    return scratch.keep(
        rows.mapInPandas(run, "task_id string, repo string, revision string, file_path string, reason string, rule string, whole string, leaf array<string>, words array<int>")
    )


def shared_hashes(hashes: DataFrame, by: str) -> DataFrame:
    """(by): hashes that occur in MIN_REPOS unrelated repositories or more; hot hashes are reduced on the map side."""
    seen = hashes.where(F.col("repo").isNotNull()).groupBy(by).agg(F.min("repo").alias("a"), F.max("repo").alias("b"))
    return seen.where("a < b").select(by)


def directory_hashes(files: DataFrame, by: tuple[str, ...] = ("repo",)) -> DataFrame:
    """(*by, dir, tree, n_files): Merkle hash of each directory over its entries (name and hash), bottom-up.

    files: (*by, file_path, whole); rows with a null in by are left out. Of several contents of one path the
    smallest hash stands for it. The hashes of the entries are added up, so a
    directory of very many entries is combined on the map side and never
    collected; each level is written, so the plan stays as small for deep trees.
    """
    scratch = Scratch(files.sparkSession, "trees")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim("file_path"), r"\\", "/"), "/+", "/"), r"^(\./|/)+", "")
    leaf = files.where("whole <> ''").dropna(subset=list(by)).select(*by, plain.alias("path"), "whole").groupBy(*by, "path").agg(F.min("whole").alias("hash"))
    parts = F.split("path", "/", DEPTH)  # what is deeper stays one name
    leaf = scratch.keep(leaf.select(*by, parts.alias("parts"), "hash", F.lit(1).cast("long").alias("n")))
    depth = leaf.agg(F.max(F.size("parts"))).first()[0] or 0
    name = F.element_at("parts", -1)
    below, levels = None, []
    for d in range(depth, 1, -1):
        here = leaf.where(F.size("parts") == d)
        here = here if below is None else here.unionByName(below)
        made = here.groupBy(*by, F.slice("parts", 1, d - 1).alias("parts")).agg(
            F.sum(F.xxhash64(name, "hash").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit(7919), name, "hash")).alias("b"), F.sum("n").alias("n")
        )
        below = scratch.keep(made.select(*by, "parts", F.md5(F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string"))).alias("hash"), "n"))
        levels.append(below)
    out = leaf.limit(0)
    for level in levels:
        out = out.unionByName(level)
    return out.select(*by, F.array_join("parts", "/").alias("dir"), F.col("hash").alias("tree"), F.col("n").alias("n_files"))


def not_handwritten(requests: DataFrame) -> DataFrame:
    """(task_id, reason, rule): generated, minified, data or vendored, and the rule that found it."""
    scratch = Scratch(requests.sparkSession, "handmade")
    files = _described(requests, scratch)
    alone = files.where("reason IS NOT NULL").select("task_id", "reason", "rule")
    open_files = files.where("reason IS NULL OR (reason = 'vendored' AND rule = 'path')").withColumn(
        "all", F.aggregate("words", F.lit(0), lambda a, n: a + n)
    )
    # short leaves mark nothing and stay out of the join, so that no such leaf makes a hot key
    long_leaves = F.filter(F.arrays_zip("leaf", "words"), lambda x: x["words"] >= LEAF)
    flat = files.where("repo IS NOT NULL").select("repo", F.explode(F.array_distinct(F.transform(long_leaves, lambda x: x["leaf"]))).alias("leaf"))
    common = shared_hashes(flat, "leaf")
    by_leaf = (
        open_files.select("task_id", "all", F.explode(long_leaves).alias("e")).select("task_id", "all", F.col("e.leaf").alias("leaf"), F.col("e.words").alias("words"))
        .join(common, "leaf", "left_semi").groupBy("task_id", "all").agg(F.sum("words").alias("copied"))
        .where(F.col("copied") >= SHARED * F.col("all")).select("task_id", F.lit("merkle leaves").alias("rule"))
    )
    size = F.aggregate("words", F.lit(0), lambda a, n: a + n)
    shared_files = shared_hashes(files.where(size >= FILE), "whole")
    by_file = open_files.join(shared_files, "whole", "left_semi").select("task_id", F.lit("merkle file").alias("rule"))
    # over all revisions, as those of a repository need not be complete, and for each, as they can differ
    every = directory_hashes(files).withColumn("revision", F.lit(None).cast("string"))
    trees = every.unionByName(directory_hashes(files, ("repo", "revision"))).where("n_files >= 2")
    dirs = trees.join(shared_hashes(trees, "tree"), "tree", "left_semi").select("repo", "revision", "dir").distinct()
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim("file_path"), r"\\", "/"), "/+", "/"), r"^(\./|/)+", "")
    parents = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("parts") - 1)), lambda i: F.array_join(F.slice("parts", F.lit(1), i), "/")))
    inside = open_files.select("task_id", "repo", "revision", F.split(plain, "/", DEPTH).alias("parts")).where(F.size("parts") > 1).select(
        "task_id", "repo", "revision", parents.alias("dir")
    )
    marked = dirs.withColumnRenamed("revision", "of")
    by_tree = inside.join(marked, ["repo", "dir"]).where("of IS NULL OR of = revision").select("task_id", F.lit("merkle directory").alias("rule"))
    copied = by_leaf.unionByName(by_file).unionByName(by_tree).select("task_id", F.lit("vendored").alias("reason"), "rule")
    first = F.min(F.struct("reason", (~F.col("rule").startswith("merkle")).alias("o"), "rule")).alias("first")
    return alone.unionByName(copied).groupBy("task_id").agg(first).select("task_id", "first.reason", "first.rule")


def rules(requests: DataFrame) -> DataFrame:
    """(reason, rule, n_files): how many files each rule finds."""
    return not_handwritten(requests).groupBy("reason", "rule").agg(F.count(F.lit(1)).alias("n_files"))


def handwritten_rates(requests: DataFrame) -> DataFrame:
    """(repo_id, reason, n_files): distinct files of each repository by reason, 'handwritten' for the rest."""
    found = not_handwritten(requests)
    files = requests.where("task_id IS NOT NULL").select("task_id", "repo_id").distinct()
    return (
        files.join(found, "task_id", "left").groupBy("repo_id", F.coalesce("reason", F.lit("handwritten")).alias("reason"))
        .agg(F.countDistinct("task_id").alias("n_files"))
    )
