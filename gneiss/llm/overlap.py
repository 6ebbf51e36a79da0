"""Same or nearly the same code in evaluation and training splits.

Fragments become token sequences without layout and comments; equal sequences
form one class, so copies are compared once. A class is described by its n-grams
of five words in which local names, numbers and strings are reduced to their
kind, so that renaming a variable changes nothing, while called and member names
stay. The hashes of the evaluation grams are joined with those of the training
grams, partitioned by gram, and the containment of each evaluation record in
each training record that it meets is computed: the share of its grams that the
other has. A pair counts as nearly the same if the containment is at least LEAST
and the longest common subsequence of the tokens makes up NEAR of both; as
contained, whatever the length of the training record, if it is at least WHOLE.
Both depend on the two records alone, never on the rest of the corpus.

The join finds every such pair. All grams have one global order, and of n grams
of an evaluation record of which need = LEAST n must be common, the first HITS
common ones lie among its first n - need + HITS, and likewise in the training
record; only entries there are indexed, only hits there counted, and a pair with
fewer is none. Any order is right; the one used puts frequent grams last, by
counts in a table of SKETCH buckets of fixed size, the one thing that is
broadcast. Grams whose bucket is overfull are spread over several tasks.

TESTDATA.md states changes to about a sixth of the tokens for this problem,
hence NEAR and LEAST below the usual 0.8 of five-word shingles.

Defined cases: null, empty and very short fragments (under MIN_TOKENS tokens)
match nothing; a null or unknown split is neither side; repeated rows of a
sample count once; ties cannot occur; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.splits import family_name
from gneiss.storage import Scratch

EVALUATION = ["calibration", "test", "temporal"]
WORDS = 5
LEAST = 0.55
WHOLE = 0.8
HITS = 3
NEAR = 0.74
RATIO = 2.0  # nearly the same records don't differ more in their numbers of grams
SKETCH = 1 << 17  # buckets of the counts that order the grams; it changes the speed only
HOT = 2_000  # grams of a bucket, beyond twice the mean, that one task joins
MIN_TOKENS = 8

_STRING = r'"""[\s\S]*?(?:"""|\Z)|\'\'\'[\s\S]*?(?:\'\'\'|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?|`(?:\\.|[^`\\])*`?'
_REST = r"|[^\W\d][\w$]*|\$[\w$]*|\d[\w.]*|[^\s\w]"
_C = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|" + _STRING + _REST)
_PYTHON = re.compile(r"#[^\n]*|" + _STRING + _REST)

# Words of the languages that are not names.
KEYWORDS = frozenset(
    "abstract and as async await bool boolean break case catch chan char class const continue def default defer del do double elif else enum"
    " except export extends extern final finally float fn for foreach from func function go goto if impl implements import in int interface is"
    " lambda let long loop match mod mut namespace new nil none not null or package pass private protected pub public raise range readonly return"
    " sealed self short static str string struct super switch this throw throws trait true try type typedef typeof undefined union unsafe use"
    " using var void volatile where while with yield false".split()
)


def tokens(code: str | None, language: str | None) -> list[str]:
    """Tokens without layout and comments."""
    if not code:
        return []
    if (language or "").strip().lower() in ("python", "py"):
        return [t for t in _PYTHON.findall(code) if t[0] != "#"]
    return [t for t in _C.findall(code) if not (t[0] == "/" and t[1:2] in ("/", "*") and len(t) > 1)]


_NAME, _FIXED, _SKIP = 1, 2, 0
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(WORDS)]


class _Table:
    """Word hash and kind of every token text, filled as texts are met."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.hashes: list[int] = []
        self.kinds: list[int] = []
        self.name = self._hash("V")

    @staticmethod
    def _hash(word: str) -> int:
        return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")

    def add(self, t: str) -> int:
        c = t[0]
        kind, word = _SKIP, t
        if c.isalpha() or c in "_$":
            kind = _FIXED if t.lower() in KEYWORDS else _NAME
        elif c.isdigit():
            kind, word = _FIXED, "N"
        elif c in "\"'`" and len(t) > 1:
            kind, word = _FIXED, "S"
        at = self.at[t] = len(self.kinds)
        self.kinds.append(kind)
        self.hashes.append(self._hash(word))
        return at


_MADE = _Table()


def grams(seqs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(grams, owner): the distinct hashed grams of the words of each sequence, and the index of their sequence; by owner, then gram."""
    global _MADE
    if len(_MADE.kinds) > 500_000:
        _MADE = _Table()
    table = _MADE
    known, add = table.at, table.add
    flat = [at if (at := known.get(t)) is not None else add(t) for s in seqs for t in s]
    code = np.array(flat, np.int64)
    owner = np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
    kind = np.array(table.kinds, np.int8)[code] if len(code) else np.zeros(0, np.int8)
    word = np.array(table.hashes, np.uint64)[code] if len(code) else np.zeros(0, np.uint64)
    same = owner[1:] == owner[:-1]
    called = np.zeros(len(code), bool)
    called[:-1] = same & (code[1:] == known.get("(", -1))
    member = np.zeros(len(code), bool)
    member[1:] = same & (code[:-1] == known.get(".", -1))
    word[(kind == _NAME) & ~called & ~member] = table.name
    word, owner = word[kind != _SKIP], owner[kind != _SKIP]
    size = np.bincount(owner, minlength=len(seqs))
    room = np.maximum(size, WORDS)  # a short sequence is one gram, filled up
    begin = np.cumsum(room) - room
    padded = np.zeros(int(room.sum()) + WORDS, np.uint64)
    padded[np.arange(len(word)) + np.repeat(begin - (np.cumsum(size) - size), size)] = word
    n = room - WORDS + 1
    owner = np.repeat(np.arange(len(seqs)), n)
    start = np.arange(len(owner)) + np.repeat(begin - (np.cumsum(n) - n), n)
    h = np.zeros(len(owner), np.uint64)
    for k in range(WORDS):
        h += padded[start + k] * _POWERS[k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    g = h.view(np.int64)
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    return g[first], owner[first]


def entries(seqs: list[list[str]], counts: np.ndarray, need, hot: float) -> pd.DataFrame:
    """(owner, gram, n, at, ways): the grams to index, those before n - need(n) + HITS in the global order; ways: tasks that join them."""
    g, owner = grams(seqs)
    load = counts[g & (len(counts) - 1)]
    order = np.lexsort((g, load, owner))
    g, load = g[order], load[order]  # owner is the first key, so it stays
    n = np.bincount(owner, minlength=len(seqs))
    at = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
    n = n[owner]
    keep = at < n - need(n) + HITS
    ways = np.maximum(load - hot, 0).astype(np.int64) // HOT + 1
    return pd.DataFrame({"owner": owner[keep], "gram": g[keep], "n": n[keep].astype(np.int32), "at": at[keep].astype(np.int32), "ways": ways[keep].astype(np.int32)})


def share(n: np.ndarray, least: float) -> np.ndarray:
    """How many of n grams make up the share."""
    return np.ceil(np.round(n * least, 6)).astype(np.int64)


def near(a: list[str], b: list[str]) -> float:
    """Share of both sequences that their longest common subsequence makes up, by bit-parallel rows."""
    at: dict[str, int] = {}
    for i, t in enumerate(a):
        at[t] = at.get(t, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        if m := at.get(t):
            u = row & m
            row = ((row + u) | (row - u)) & full
    common = len(a) - row.bit_count()
    return 2 * common / (len(a) + len(b))


def side(split: Column) -> Column:
    """1 for an evaluation split, 0 for train, null for others."""
    s = F.lower(F.trim(split))
    return F.when(s == "train", 0).when(s.isin(EVALUATION), 1)


def _classes(samples: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """members (cls, sample_id, side, split, family) and classes (id, cls, seq, in_eval, in_train), both written, and the counts of grams by bucket."""
    rows = samples.where("sample_id IS NOT NULL AND fragment IS NOT NULL").select(
        "sample_id", side(F.col("split")).alias("side"), F.lower(F.trim("split")).alias("split"),
        family_name(F.col("repo_family")).alias("family"), "code_language", "fragment",
    ).where("side IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, named = np.zeros(SKETCH, np.int64), ["sample_id", "side", "split", "family"]
        for b in batches:
            rows = zip(*(b[c].tolist() for c in named), b["fragment"].tolist(), b["code_language"].tolist())
            kept = [(*r[:4], s) for r in rows if len(s := tokens(r[4], r[5])) >= MIN_TOKENS]
            counts += np.bincount(grams([r[4] for r in kept])[0] & (SKETCH - 1), minlength=SKETCH)
            texts = ["\x1f".join(r[4]) for r in kept]
            hashes = [hashlib.md5(s.encode("utf-8", "surrogatepass")).digest() for s in texts]
            out = [(*r[:4], h, s, None) for r, h, s in zip(kept, hashes, texts)]
            yield pd.DataFrame(out, columns=[*named, "cls", "seq", "counts"])
        # one row a task with its counts
        yield pd.DataFrame({"sample_id": [None], "side": [None], "split": [None], "family": [None], "cls": [None], "seq": [None], "counts": [counts.astype("<i8").tobytes()]})

    cut = scratch.keep(rows.mapInPandas(run, "sample_id string, side int, split string, family string, cls binary, seq string, counts binary"))

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SKETCH, np.int64)
        for b in batches:
            for c in b["counts"]:
                counts += np.frombuffer(c, "<i8")
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"bucket": at, "n": counts[at]})

    sketch = cut.where("counts IS NOT NULL").select("counts").mapInPandas(unpack, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SKETCH, np.int64)
    counts[sketch["bucket"].to_numpy(np.int64)] = sketch["n"].to_numpy(np.int64)
    named = cut.where("cls IS NOT NULL")
    members = scratch.keep(named.select("cls", "sample_id", "side", "split", "family"))
    classes = named.groupBy("cls").agg(F.first("seq").alias("seq"), F.max("side").alias("in_eval"), (1 - F.min("side")).alias("in_train"))
    classes = scratch.keep(classes.withColumn("id", F.monotonically_increasing_id()))
    scratch.free(cut)
    return members, classes, counts


def candidates(classes: DataFrame, counts: np.ndarray, least: float, ratio: float | None) -> DataFrame:
    """(e, t): ids of evaluation and training classes with a containment of least or more, and some others.

    ratio: with it, only pairs whose numbers of grams differ by no more than that.
    """
    shared = classes.sparkSession.sparkContext.broadcast(counts)
    hot = 2.0 * float(counts.mean())

    def index(need) -> object:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                e = entries([s.split("\x1f") for s in b["seq"]], shared.value, need, hot)
                e["id"] = b["id"].to_numpy()[e.pop("owner")]
                yield e[["id", "gram", "n", "at", "ways"]]

        return run

    schema = "id long, gram long, n int, at int, ways int"
    of_eval = lambda n: share(n, least)
    of_train = (lambda n: share(n / ratio, least)) if ratio else (lambda n: np.zeros_like(n))
    a = classes.where("in_eval = 1").select("id", "seq").mapInPandas(index(of_eval), schema).select(
        "gram", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"), F.col("id").alias("e"), F.col("n").alias("en"), F.col("at").alias("ea")
    )
    b = classes.where("in_train = 1").select("id", "seq").mapInPandas(index(of_train), schema).select(
        "gram", F.pmod(F.xxhash64("id"), "ways").cast("int").alias("way"), F.col("id").alias("t"), F.col("n").alias("tn"), F.col("at").alias("ta")
    )
    need = F.ceil(F.round(F.col("en") * least, 6))
    first = (F.col("ea") < F.col("en") - need + HITS) & (F.col("ta") < F.col("tn") - need + HITS) & (F.col("tn") >= need)
    if ratio:
        first = first & (F.col("tn") <= F.col("en") * ratio) & (F.col("en") <= F.col("tn") * ratio)
    hits = a.join(b, ["gram", "way"]).where((F.col("e") != F.col("t")) & first)
    return (
        hits.groupBy("e", "t").agg(F.count(F.lit(1)).alias("hits"), F.min(need).alias("need"))
        .where(F.col("hits") >= F.least(F.lit(HITS), F.col("need"))).select("e", "t")
    )


def _compared(classes: DataFrame, pairs: DataFrame, least: float, near_least: float) -> DataFrame:
    """(eval_cls, train_cls, containment, similarity) of the pairs that reach both; similarity is computed only for near_least above 0."""
    a = classes.select(F.col("id").alias("e"), F.col("cls").alias("eval_cls"), F.col("seq").alias("a"))
    b = classes.select(F.col("id").alias("t"), F.col("cls").alias("train_cls"), F.col("seq").alias("b"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            xs, ys = [s.split("\x1f") for s in p["a"]], [s.split("\x1f") for s in p["b"]]
            (ga, oa), (gb, ob) = grams(xs), grams(ys)
            n = np.bincount(oa, minlength=len(xs))
            # grams of both in one order: a gram that stands twice in a row of one pair is common
            g, o = np.concatenate([ga, gb]), np.concatenate([oa, ob])
            order = np.lexsort((g, o))
            g, o = g[order], o[order]
            both = np.bincount(o[1:][(g[1:] == g[:-1]) & (o[1:] == o[:-1])], minlength=len(xs))
            p["containment"] = both / np.maximum(n, 1)
            good = both >= share(n, least)
            p["similarity"] = [near(x, y) if k and near_least > 0 else 0.0 for x, y, k in zip(xs, ys, good)]
            yield p.loc[good & (p["similarity"] >= near_least), ["eval_cls", "train_cls", "containment", "similarity"]]

    return pairs.join(a, "e").join(b, "t").select("eval_cls", "train_cls", "a", "b").mapInPandas(
        compare, "eval_cls binary, train_cls binary, containment double, similarity double"
    )


def _same(classes: DataFrame) -> DataFrame:
    one = F.lit(1.0)
    return classes.where("in_eval = 1 AND in_train = 1").select(
        F.col("cls").alias("eval_cls"), F.col("cls").alias("train_cls"), one.alias("containment"), one.alias("similarity")
    )


def class_pairs(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): pairs (eval_cls, train_cls, containment, similarity) of classes that are the same or nearly so."""
    scratch = Scratch(samples.sparkSession, "overlap")
    members, classes, counts = _classes(samples, scratch)
    close = _compared(classes, candidates(classes, counts, LEAST, RATIO), LEAST, NEAR)
    return members, scratch.keep(close.unionByName(_same(classes)))


def contained_records(samples: DataFrame) -> DataFrame:
    """(sample_id, split, n_records, containment): evaluation samples of which WHOLE or more is contained in a training record of any length.

    n_records counts the training samples that contain it; containment is the largest. One row a sample, copies are never paired.
    """
    scratch = Scratch(samples.sparkSession, "contained")
    members, classes, counts = _classes(samples, scratch)
    found = _compared(classes, candidates(classes, counts, WHOLE, None), WHOLE, 0.0).unionByName(_same(classes))
    copies = members.where("side = 0").select("cls", "sample_id").distinct().groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    per = found.join(copies, F.col("train_cls") == F.col("cls")).groupBy("eval_cls").agg(F.sum("n").alias("n_records"), F.max("containment").alias("containment"))
    m = members.where("side = 1").select("cls", "sample_id", "split").distinct()
    return m.join(per, F.col("cls") == F.col("eval_cls")).groupBy("sample_id", "split").agg(
        F.max("n_records").alias("n_records"), F.round(F.max("containment"), 6).alias("containment")
    )


def sample_pairs(samples: DataFrame) -> DataFrame:
    """(sample_a, sample_b, similarity), sample_a < sample_b: one in train, one in an evaluation split."""
    members, pairs = class_pairs(samples)
    m = members.select("cls", "sample_id", "side").distinct()
    e = m.where("side = 1").select(F.col("cls").alias("eval_cls"), F.col("sample_id").alias("e"))
    t = m.where("side = 0").select(F.col("cls").alias("train_cls"), F.col("sample_id").alias("t"))
    out = pairs.join(e, "eval_cls").join(t, "train_cls").where("e <> t")
    return (
        out.select(F.least("e", "t").alias("sample_a"), F.greatest("e", "t").alias("sample_b"), "similarity")
        .groupBy("sample_a", "sample_b").agg(F.max("similarity").alias("similarity"))
    )


def overlap_report(samples: DataFrame) -> DataFrame:
    """(split, family, n_samples, n_exact, n_near): evaluation samples that recur in train, per split and family.

    n_samples counts the samples long enough to be compared; n_exact those with
    an equal sequence in train; n_near those with only a nearly equal one.
    """
    members, pairs = class_pairs(samples)
    best = pairs.groupBy("eval_cls").agg(F.max((F.col("eval_cls") == F.col("train_cls")).cast("int")).alias("exact"))
    m = members.where("side = 1").select("cls", "sample_id", "split", "family").distinct()
    return (
        m.join(best, m.cls == best.eval_cls, "left")
        .groupBy("split", "family")
        .agg(
            F.countDistinct("sample_id").alias("n_samples"),
            F.countDistinct(F.when(F.col("exact") == 1, F.col("sample_id"))).alias("n_exact"),
            F.countDistinct(F.when(F.col("exact") == 0, F.col("sample_id"))).alias("n_near"),
        )
    )
