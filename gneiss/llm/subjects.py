"""Subject areas of documents by class-association rules.

Sentences are transactions of words. Rules from word sets to areas are mined by
parallel frequent-pattern growth in ROUNDS rounds: first from the labelled
examples, then from the sentences of all documents that the rules so far give to
one area clearly, so that words the examples lack are learnt from their company.
Documents with hardly any evidence count as a class of their own there, so that
the common words of a language, or of an area, that the rules don't know yet are
not taken for signs of another. Each document is cut into sentences once; the
rounds and the final scoring read these.

Growth: the words that are frequent are counted first. Each batch then adds up,
for each frequent word, the frequent words of its conditional base (those before
it in its sentences) by area; the sums of these over all batches are the supports
of the sets of MAX_ITEMS words, where growth ends. So no task holds the base of a
word whole. Supports stay in DataFrames, where the confidence, normalised by the
size of the areas, is computed and rules that a shorter one makes redundant are
pruned. Frequent means LEAST_SHARE of the sentences, so there are at most
1/LEAST_SHARE frequent words a word of the average sentence, and only they and
the final rules are ever broadcast.

Every sentence of every document is scored by the calibrated evidence (log odds)
of its most specific matching rules, and a document is about each area that has
at least SHARE of its sentences with evidence, unless they are a passing mention.

Defined cases: null, empty and blank texts, dumps and texts without evidence
have no area; repeated documents are each scored; wrong labels in the examples
only lower confidences; lines of program code are no sentences; very long texts
are scored whole; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.storage import Scratch

SHARE = 0.25
LEAST_OF_ALL = 0.12
EVIDENCE = 2.2
WEAK_EVIDENCE = 0.6  # enough to label a sentence while rules are still being learnt
ROUNDS = 4
UNKNOWN = "?"
CLEAR = 0.75
CONFIDENCE = 0.7
WEAK = 0.6  # confidence of the rules of the first round, of which some rest on one example
MAX_ITEMS = 2
LEAST_SHARE = 1 / 20_000  # support of frequent words and word pairs, as a share of the sentences
LEAST = 8  # but at least so many sentences
PAIRS = 1 << 22  # pairs of words that are counted at once

_SENTENCE = re.compile(r"[\n\r  ]+|(?<=[.?!;])\s+|(?<=[。？！])")
_CODE = re.compile(
    r"[{};]\s*$|^\s*[})\]]|^\s*(?:export|import|from|package|func|function|def|class|return|const|let|var|for|if|else|elif|while|fn|pub|use|struct|impl|public|private"
    r"|protected|static|async|int|void|bool|type|interface|using|namespace|#include)\b.*[({:;=)]\s*\S*$|:=|[+*/-]=|^\s*[\w.]+\([^()]*\)\s*$|^\s*return\s+\S+$|^\s*[\w.]+ = \S"
)
_COMMENT = re.compile(r"^\s*(?://|#|\*|/\*|--|\"\"\"|\d+\.|-)\s*")
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-Z])")
_CJK = re.compile("[぀-ヿ㐀-鿿]")


# invisible and control characters; beyond these ranges there are none
_DROPPED = {c: None for r in (range(0x20000), range(0xE0000, 0xE1000)) for c in r if unicodedata.category(chr(c)) in ("Cf", "Cc") and chr(c) not in "\n\r\t"}
_CODE_SIGN = re.compile(r"[{}()\]:;=]|^\s*return\s")  # what every line of code has


def _words(s: str) -> tuple[str, ...]:
    """Sorted distinct words of a sentence; none for blank ones and lines of code."""
    if not s.strip():
        return ()
    if _CODE_SIGN.search(s) and _CODE.search(s) and (not _COMMENT.match(s) or s.lstrip().startswith("-")):
        return ()
    words = set()
    for w in _WORD.findall(_CAMEL.sub(" ", s).lower()):
        if not w.isascii() and _CJK.search(w):
            words.update([w[i : i + 2] for i in range(len(w) - 1)])
        elif len(w) > 2:
            words.add(w[:-1] if len(w) > 4 and w[-1] == "s" else w)
    return tuple(sorted(words))


def sentences(text: str | None) -> list[tuple[str, ...]]:
    """Distinct words of each sentence of prose; Japanese as pairs of characters, plurals without s."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_DROPPED)
    out = []
    for s in _SENTENCE.split(text):
        if words := _words(s):
            out.append(words)
    return out


Rules = dict[tuple[str, ...], tuple[str, float]]


def _flat(lines: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Sizes and elements of the lists of an array."""
    return lines.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lines.flatten()


def _codes(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Position of each word in the known ones, -1 for others."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _pairs(line: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of words of the same sentence, by the sentence of each word."""
    at, step = np.arange(len(line)), 1
    while len(at := at[: np.searchsorted(at, len(line) - step)]):
        at = at[line[at + step] == line[at]]
        yield at, at + step
        step += 1


def _tally(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and how often each occurs."""
    found = pc.value_counts(pa.array(np.concatenate(codes)))
    return found.field(0).to_numpy(), found.field(1).to_numpy()


class Model:
    """Rules as arrays, by which all sentences of a batch are scored at once."""

    def __init__(self, rules: Rules):
        self.areas = sorted({area for area, _ in rules.values()})
        self.words = pa.array(sorted({w for k in rules for w in k}), pa.string())
        at = {w: i for i, w in enumerate(self.words.to_pylist())}
        number = {a: i for i, a in enumerate(self.areas)}
        self.area = np.full(len(at), -1)
        self.evidence = np.zeros(len(at))
        for k, (area, e) in rules.items():
            if len(k) == 1:
                self.area[at[k[0]]], self.evidence[at[k[0]]] = number[area], e
        # the rules of two words, the surest first
        pairs = sorted((-e, at[k[0]], at[k[1]], number[area]) for k, (area, e) in rules.items() if len(k) > 1)
        code = np.array([a * len(at) + b for _, a, b, _ in pairs], np.int64)
        self.rank = np.argsort(code)
        self.code = code[self.rank]
        self.pair_area = np.array([area for *_, area in pairs], np.int64)
        self.pair_evidence = np.array([-e for e, *_ in pairs], np.float64)
        self.first, self.second = np.zeros(len(at), bool), np.zeros(len(at), bool)
        for _, a, b, _ in pairs:
            self.first[a] = self.second[b] = True

    def score(self, size: np.ndarray, words: pa.Array, least: float = EVIDENCE) -> np.ndarray:
        """Area of each sentence (of sorted words), -1 for none; most specific rules first, each word used once."""
        code = _codes(words, self.words)
        known = np.flatnonzero(code >= 0)
        code, line = code[known], np.repeat(np.arange(len(size)), size)[known]
        used = np.zeros(len(code), bool)
        lines, areas, evidence = [], [], []
        a, b, rank = self._paired(code, line)
        while len(a):  # the surest rule of each sentence, then of what is left
            top = np.flatnonzero(np.concatenate([[True], line[a[1:]] != line[a[:-1]]]))
            used[a[top]] = used[b[top]] = True
            lines.append(line[a[top]])
            areas.append(self.pair_area[rank[top]])
            evidence.append(self.pair_evidence[rank[top]])
            left = ~(used[a] | used[b])
            a, b, rank = a[left], b[left], rank[left]
        one = np.flatnonzero(~used & (self.area[code] >= 0))
        lines, areas, evidence = [*lines, line[one]], [*areas, self.area[code[one]]], [*evidence, self.evidence[code[one]]]
        n = len(self.areas)
        total = np.bincount(np.concatenate(lines) * n + np.concatenate(areas), np.concatenate(evidence), len(size) * n).reshape(len(size), n)
        area, each = total.argmax(axis=1), np.arange(len(size))
        best = total[each, area]
        total[each, area] = 0.0
        return np.where((best >= least) & (best - total.max(axis=1) > 0.4), area, -1)

    def _paired(self, code: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of the words of matching rules of two words and the rule, by sentence, the surest first."""
        some = np.flatnonzero(self.first[code] | self.second[code])
        code, line = code[some], line[some]
        found = [(some[:0], some[:0], self.rank[:0])]
        for a, b in _pairs(line):
            may = self.first[code[a]] & self.second[code[b]]
            a, b = a[may], b[may]
            want = code[a] * len(self.words) + code[b]
            at = np.minimum(np.searchsorted(self.code, want), len(self.code) - 1)
            hit = self.code[at] == want
            found.append((some[a[hit]], some[b[hit]], self.rank[at[hit]]))
        a, b, rank = (np.concatenate(x) for x in zip(*found))
        line = line[np.searchsorted(some, a)]
        order = np.lexsort((rank, line))
        return a[order], b[order], rank[order]

    def count(self, parts: pa.Array, least: float = EVIDENCE) -> tuple[np.ndarray, np.ndarray]:
        """Sentences of each document by area, and all its sentences."""
        every, lines = _flat(parts)
        area = self.score(*_flat(lines), least)
        doc = np.repeat(np.arange(len(every)), every)[area >= 0]
        n = len(self.areas)
        return np.bincount(doc * n + area[area >= 0], minlength=len(every) * n).reshape(len(every), n), every


def _words_by_area(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, area, n): sentences of a batch by word and area."""
    for b in batches:
        size, words = _flat(b.column("words"))
        words, area = words.dictionary_encode(), b.column("area").dictionary_encode()
        n = max(1, len(area.dictionary))
        code, count = _tally([words.indices.to_numpy() * np.int64(n) + np.repeat(area.indices.to_numpy(), size)])
        yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code // n)), area.dictionary.take(pa.array(code % n)), pa.array(count)], ["w", "area", "n"])


def _bases(transactions: DataFrame, frequent: list[str], areas: list[str]) -> DataFrame:
    """(pair, area, n): for each frequent word j the words i before it in the sentences of a batch, pair being i * |frequent| + j."""
    shared = transactions.sparkSession.sparkContext.broadcast((frequent, areas))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, names = (pa.array(x, pa.string()) for x in shared.value)
        v, n = len(words), len(names)

        def counted(codes: list[np.ndarray]) -> pa.RecordBatch:
            code, count = _tally(codes)
            return pa.RecordBatch.from_arrays([pa.array(code // n), pa.array(code % n), pa.array(count)], ["pair", "area", "n"])

        for b in batches:
            size, found = _flat(b.column("words"))
            code = _codes(found, words)
            at = np.repeat(np.arange(len(size)), size)[code >= 0] * v + code[code >= 0]
            at.sort()
            line, code, area = at // v, at % v, _codes(b.column("area"), names)
            codes, held = [], 0
            for i, j in _pairs(line):
                codes.append((code[i] * v + code[j]) * n + area[line[i]])
                held += len(i)
                if held >= PAIRS:
                    yield counted(codes)
                    codes, held = [], 0
            if held:
                yield counted(codes)

    return transactions.select("words", "area").mapInArrow(run, "pair long, area long, n long")


def mine(transactions: DataFrame, least: int, confidence: float = CONFIDENCE) -> tuple[Rules, set[str]]:
    """Rules {words} -> area from (words, area) by parallel frequent-pattern growth, and the words seen often enough to judge."""
    spark = transactions.sparkSession
    sizes = {r[0]: r[1] for r in transactions.groupBy("area").agg(F.count(F.lit(1))).collect()}
    total = sum(sizes.values())
    if not total:
        return {}, set()
    scratch = Scratch(spark, "growth")
    each = transactions.select("words", "area").mapInArrow(_words_by_area, "w string, area string, n long").groupBy("w", "area").agg(F.sum("n").alias("n"))
    every = each.groupBy("w").agg(F.sum("n").alias("all"), F.collect_list(F.struct("area", "n")).alias("by")).where(F.col("all") >= least)
    singles = scratch.keep(every.select("w", F.explode("by").alias("e")).select(F.array("w").alias("words"), "e.area", "e.n"))
    seen = sorted(r[0] for r in singles.select(F.col("words")[0]).distinct().collect())
    areas = sorted(sizes)
    based = _bases(transactions, seen, areas).groupBy("pair", "area").agg(F.sum("n").alias("n"))
    often = based.groupBy("pair").agg(F.sum("n").alias("all"), F.collect_list(F.struct("area", "n")).alias("by")).where(F.col("all") >= max(least, 3))
    at = F.array(*[F.lit(a) for a in areas])
    grown = often.select("pair", F.explode("by").alias("e")).select(
        F.expr(f"CAST(pair DIV {max(1, len(seen))} AS INT)").alias("i"), (F.col("pair") % max(1, len(seen))).cast("int").alias("j"), at[F.col("e.area").cast("int")].alias("area"), "e.n"
    )
    names = spark.createDataFrame(list(enumerate(seen)), "k int, w string") if seen else spark.createDataFrame([], "k int, w string")
    a, b = names.toDF("i", "wi"), names.toDF("j", "wj")
    pairs = grown.join(a, "i").join(b, "j").select(F.array("wi", "wj").alias("words"), "area", "n")
    size_of = F.create_map(*[F.lit(x) for area, n in sizes.items() for x in (area, float(n))])
    supports = singles.unionByName(pairs).select("words", "area", (F.col("n") / size_of[F.col("area")]).alias("rate"))
    # the best area, the smaller of equal ones; smoothing: half an observation of every other area
    judged = supports.groupBy("words").agg(F.sum("rate").alias("sum"), F.max(F.struct("rate", F.struct((-F.ascii("area")).alias("o"), "area").alias("a"))).alias("top"))
    sure = scratch.keep(
        judged.select("words", F.col("top.a.area").alias("area"), (F.col("top.rate") / (F.col("sum") + F.lit(0.5 * len(sizes) / total))).alias("conf"))
        .where((F.col("area") != UNKNOWN) & (F.col("conf") >= confidence))
        .withColumn("evidence", F.round(F.log(F.col("conf") / (1 - F.col("conf") + 1e-3)), 4))
    )
    one = sure.where(F.size("words") == 1).select(F.col("words")[0].alias("w"), F.col("area").alias("one_area"), F.col("conf").alias("one_conf"), F.col("evidence").alias("one"))
    more = sure.where(F.size("words") > 1)
    # redundant: a shorter rule is about as sure, or the shorter rules together give as much evidence
    covered = (
        more.select("words", "area", "conf", "evidence", F.explode("words").alias("w")).join(one, "w").where("area = one_area")
        .groupBy("words", "conf", "evidence").agg(F.max("one_conf").alias("best"), F.sum("one").alias("together"))
        .where((F.col("best") >= F.col("conf") - 0.02) | (F.col("together") >= F.col("evidence"))).select("words")
    )
    kept = sure.where(F.size("words") == 1).unionByName(more.join(covered, "words", "left_anti"))
    rules = {tuple(r[0]): (r[1], r[2]) for r in kept.select("words", "area", "evidence").collect()}
    return rules, set(seen)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, parts): the sentences of each document that has any."""
    for b in batches:
        parts = [sentences(t) for t in b.column("text").to_pylist()]
        some = [i for i, p in enumerate(parts) if p]
        lines = pa.array([parts[i] for i in some], pa.list_(pa.list_(pa.string())))
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(some, pa.int64())), lines], ["doc_id", "parts"])


def learn(split: DataFrame, examples: DataFrame) -> Rules:
    """The rules of all rounds, from (doc_id, parts) of all documents."""
    spark = split.sparkSession
    rows = examples.select("text", "subject").where("text IS NOT NULL AND subject IS NOT NULL")
    schema = "words array<string>, area string"
    scratch = Scratch(spark, "subjects")

    def label_given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(p, area) for t, area in zip(b.column("text").to_pylist(), b.column("subject").to_pylist()) for p in sentences(t)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.list_(pa.string())), pa.array([a for _, a in out], pa.string())], ["words", "area"])

    rules, _ = mine(scratch.keep(rows.mapInArrow(label_given, schema)), 1, WEAK)
    if not rules:
        return {}
    taught = rules
    for turn in range(ROUNDS - 1):
        least = WEAK_EVIDENCE if turn < ROUNDS - 2 else 1.2
        shared = spark.sparkContext.broadcast(Model(rules))

        def label(batches: Iterator[pa.RecordBatch], shared=shared, least=least) -> Iterator[pa.RecordBatch]:
            model = shared.value
            names = pa.array([*model.areas, UNKNOWN], pa.string())
            for b in batches:
                by, every = model.count(b.column("parts"), least)
                marked = by.sum(axis=1)
                unknown = (every >= 4) & (marked < 0.35 * every)
                clear = (marked >= 2) & (by.max(axis=1) >= CLEAR * marked)
                area = np.repeat(np.where(unknown, len(names) - 1, np.where(clear, by.argmax(axis=1), -1)), every)
                words = b.column("parts").flatten().filter(pa.array(area >= 0))
                yield pa.RecordBatch.from_arrays([words, names.take(pa.array(area[area >= 0]))], ["words", "area"])

        labelled = scratch.keep(split.select("parts").mapInArrow(label, schema))
        more, seen = mine(labelled, max(LEAST, int(labelled.count() * LEAST_SHARE)))
        if not more:
            break
        # what earlier rounds knew stays where this one has seen too little to judge; while rules are still being
        # learnt, what the examples teach stays where this round knows no other area
        rules = more | {k: v for k, v in rules.items() if k not in more and not seen.issuperset(k)}
        if turn < ROUNDS - 2:
            rules |= {k: v for k, v in taught.items() if k not in rules}
        scratch.free(labelled)
    return rules


def document_areas(documents: DataFrame, examples: DataFrame) -> DataFrame:
    """(doc_id, subject, share): the areas of each document; share of its sentences with evidence."""
    spark = documents.sparkSession
    schema = "doc_id long, subject string, share double"
    split = Scratch(spark, "sentences").keep(documents.where("text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut, "doc_id long, parts array<array<string>>"))
    rules = learn(split, examples)
    if not rules:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(Model(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array(model.areas, pa.string())
        for b in batches:
            by, every = model.count(b.column("parts"))
            marked = by.sum(axis=1)
            doc, area = np.nonzero((by > 0) & (by >= SHARE * marked[:, None]) & (by >= LEAST_OF_ALL * every[:, None]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(doc)), names.take(pa.array(area)), pa.array(by[doc, area] / marked[doc])], ["doc_id", "subject", "share"]
            )

    return split.mapInArrow(run, schema)


def composition(documents: DataFrame, examples: DataFrame) -> DataFrame:
    """(source, subject, n_documents, n_chars): the corpus by subject and source; 'none' for documents without area."""
    found = document_areas(documents, examples).select("doc_id", "subject").distinct()
    base = documents.select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    return (
        base.join(found, "doc_id", "left").groupBy("source", F.coalesce("subject", F.lit("none")).alias("subject"))
        .agg(F.count(F.lit(1)).alias("n_documents"), F.sum("chars").alias("n_chars"))
    )
