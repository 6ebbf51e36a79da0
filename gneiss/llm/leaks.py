"""Evaluation texts that leak into training text, by a generalised suffix automaton.

All items are normalised to words and put into one suffix automaton. The words
of a document are streamed through it; at each position the automaton's state
is the longest run of words that ends there and occurs in some item. Runs of at
least MIN_RUN words are placed in their items, and runs that follow each other
in both the document and the item, with at most GAP words between them on
either side, are chained, so that single changed words don't hide a passage. A
chain is a leak if it exceeds the limits: it matches at least MIN_WORDS words of
its item (all of a shorter one) and covers its span of the item to at least
MIN_COVER. without_leaks() removes the spans of all leaks from the documents.

Items of more than BLOCK_WORDS words in all are cut by hash into blocks, each
with an automaton of its own that the documents stream through, so that what is
broadcast has a bound (BLOCK_WORDS on average, and the largest item) and nothing
is left out.

Defined cases: null, empty and blank texts contain nothing and are contained
in nothing; an item shorter than MIN_WORDS words, of one word even, is found
only if it is matched whole; equal items are all reported; repeated documents
are all reported; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_RUN = 2
GAP = 4
MIN_WORDS = 15
MIN_COVER = 0.6
BLOCK_WORDS = 1_000_000

_WORD = re.compile(r"\w+")
_DROPPED = ("Cf", "Mn", "Cc")


def words(text: str | None) -> list[str]:
    """Lower-case words without punctuation, layout, and invisible characters."""
    return _WORD.findall(_clean(text)) if text else []


def _clean(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in text if unicodedata.category(c) not in _DROPPED or c in "\n\t\r")
    return text.lower().replace("_", " ")


def located(text: str) -> tuple[str, list[tuple[int, int]]]:
    """(text, (start, end) of each of its words).

    The text itself if its characters can be normalised one by one, with the
    marks that follow them, else its normal form.
    """
    if text.isascii():
        return text, [m.span() for m in _WORD.finditer(_clean(text))]
    for source in (text, unicodedata.normalize("NFKC", text)):
        made, at = [], []
        i = 0
        while i < len(source):
            j = i + 1
            while j < len(source) and unicodedata.category(source[j]) in _DROPPED and source[j] not in "\n\t\r":
                j += 1
            plain = _clean(source[i:j])
            made.append(plain)
            at += [i] * len(plain)
            i = j
        at.append(len(source))
        flat = "".join(made)
        spans = [m.span() for m in _WORD.finditer(flat)]
        if [flat[a:b] for a, b in spans] == words(text):
            return source, [(at[a], at[b]) for a, b in spans]
    plain = _clean(text)
    return plain, [m.span() for m in _WORD.finditer(plain)]


class Automaton:
    """Suffix automaton of several word sequences; word ids are dense, sequences don't run into each other."""

    def __init__(self, sequences: list[list[str]]):
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)), ends)
                ends[last].append((number, at))
        self.ends = self._places(ends)
        # items of fewer words than a run has, found by their words
        self.short: dict[tuple[str, ...], list[int]] = {}
        for number, sequence in enumerate(sequences):
            if 0 < len(sequence) < MIN_RUN:
                self.short.setdefault(tuple(sequence), []).append(number)

    def _extend(self, last: int, word: int, ends: list) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(word)) is not None:
            return q if length[q] == length[last] + 1 else self._split(last, word, q, ends)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        ends.append([])
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q, ends)
        return new

    def _split(self, p: int, word: int, q: int, ends: list) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        ends.append([])
        link[q] = copy
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        return copy

    def _places(self, ends: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
        """For each state of MIN_RUN words or more, the places at which its runs end."""
        order = sorted(range(1, len(ends)), key=self.length.__getitem__, reverse=True)
        for s in order:
            up = self.link[s]
            if up > 0 and self.length[up] >= MIN_RUN:
                ends[up].extend(ends[s])
        return [sorted(set(e)) if self.length[s] >= MIN_RUN else [] for s, e in enumerate(ends)]

    def runs(self, text: list[str]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the maximal matches in the text of MIN_RUN words or more."""
        nxt, link, length, vocabulary = self.next, self.link, self.length, self.vocabulary
        state = n = 0
        for at, word in enumerate(text):
            w = vocabulary.get(word, -1)
            go = nxt[state].get(w)
            if go is None:
                if n >= MIN_RUN:
                    yield at - 1, n, state
                while state > 0 and w not in nxt[state]:
                    state = link[state]
                    n = length[state]
                if (go := nxt[state].get(w)) is None:
                    state = n = 0
                    continue
            state, n = go, n + 1
        if n >= MIN_RUN:
            yield len(text) - 1, n, state


Chain = tuple[int, int, int, int, int]  # matched words, start and end in the item, start and end in the text


def chains(runs: list[tuple[int, int, int]]) -> list[Chain]:
    """The chains of runs (text start, item start, length), the best first; each run is in one of them at most."""
    runs = sorted(set(runs))
    reach = max((n for _, _, n in runs), default=0) + GAP
    score: list[int] = []
    before: list[int] = []
    low = 0
    for i, (a, b, n) in enumerate(runs):
        got, prev = n, -1
        while runs[low][0] + reach < a:
            low += 1
        for j in range(low, i):
            c, d, m = runs[j]
            over = max(0, c + m - a, d + m - b)  # words that both runs claim
            if c < a and d < b and over < n and a - c - m <= GAP and b - d - m <= GAP and score[j] + n - over > got:
                got, prev = score[j] + n - over, j
        score.append(got)
        before.append(prev)
    out: list[Chain] = []
    used: set[int] = set()
    for i in sorted(range(len(runs)), key=lambda i: (-score[i], i)):
        at, part = i, []
        while at >= 0 and at not in used:
            part.append(at)
            at = before[at]
        if at >= 0 or not part:
            continue
        used.update(part)
        (a, b, n), (c, d, _) = runs[i], runs[part[-1]]
        out.append((score[i], d, b + n, c, a + n))
    return out


def matches(automaton: Automaton, text: list[str]) -> dict[int, list[Chain]]:
    """item number -> its chains in the text."""
    placed: dict[int, list[tuple[int, int, int]]] = {}
    for end, n, state in automaton.runs(text):
        for item, at in automaton.ends[state]:
            placed.setdefault(item, []).append((end - n + 1, at - n + 1, n))
    out = {item: chains(r) for item, r in placed.items()}
    if automaton.short:
        for at, word in enumerate(text):
            for item in automaton.short.get((word,), ()):
                out.setdefault(item, []).append((1, 0, 1, at, at + 1))
    return out


def leak(chain: Chain, size: int) -> bool:
    """Whether a chain exceeds the limits for an item of size words."""
    return chain[0] >= min(MIN_WORDS, size) and chain[0] >= MIN_COVER * (chain[2] - chain[1])


_MADE: dict[str, tuple[Automaton, list[tuple[int, int]]]] = {}


def _automaton(key: str, texts: list[tuple[int, str]]) -> tuple[Automaton, list[tuple[int, int]]]:
    """The automaton of a block of items, made once a worker, and (item_id, words) of its items."""
    if key not in _MADE:
        _MADE.clear()
        split = [(i, words(t)) for i, t in texts]
        _MADE[key] = Automaton([w for _, w in split]), [(i, len(w)) for i, w in split]
    return _MADE[key]


def _blocks(items: DataFrame) -> Iterator[tuple]:
    """(broadcast key, broadcast texts) of each block of the items."""
    import uuid

    rows = items.select("item_id", "text").where("item_id IS NOT NULL AND trim(text) <> ''").distinct()
    rows = rows.withColumn("size", F.length("text") - F.length(F.regexp_replace("text", r"\s+", "")) + 1)
    total = rows.agg(F.sum("size")).first()[0] or 0
    blocks = 1 if total <= BLOCK_WORDS else -(-2 * total // BLOCK_WORDS)
    for k in range(blocks):
        texts = sorted((r[0], r[1]) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).select("item_id", "text").collect())
        if texts:
            yield items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, texts))


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched_words, item_words): documents with a passage of an item."""
    schema = "doc_id long, item_id long, matched_words int, item_words int"
    found = documents.sparkSession.createDataFrame([], schema)
    for shared in _blocks(items):

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            automaton, known = _automaton(*shared.value)
            for b in batches:
                out = []
                for doc, text in zip(b["doc_id"], b["text"]):
                    for item, found in matches(automaton, words(text)).items():
                        good = [c[0] for c in found if leak(c, known[item][1])]
                        if good:
                            out.append((doc, known[item][0], max(good), known[item][1]))
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "matched_words", "item_words"])

        found = found.unionByName(documents.select("doc_id", "text").where("text IS NOT NULL").mapInPandas(run, schema))
    return found.groupBy("doc_id", "item_id").agg(F.max("matched_words").alias("matched_words"), F.max("item_words").alias("item_words"))


def without_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text, n_spans, removed_words): every document without the spans of its leaks.

    Overlapping and touching spans are one; a blank stands for each. Texts
    without leaks stay as they are, null ones too, with 0 spans.
    """
    rows = documents.select("doc_id", "text", F.lit(0).alias("n_spans"), F.lit(0).alias("removed_words"))
    for shared in _blocks(items):

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            automaton, known = _automaton(*shared.value)
            for b in batches:
                out = []
                for doc, text, n, removed in zip(b["doc_id"], b["text"], b["n_spans"], b["removed_words"]):
                    found = matches(automaton, words(text))
                    spans = sorted((c[3], c[4]) for item, cs in found.items() for c in cs if leak(c, known[item][1]))
                    if spans:
                        text, places = located(text)
                        joined = [list(spans[0])]
                        for a, z in spans[1:]:
                            if a <= joined[-1][1]:
                                joined[-1][1] = max(joined[-1][1], z)
                            else:
                                joined.append([a, z])
                        for a, z in reversed(joined):
                            text = text[: places[a][0]] + " " + text[places[z - 1][1] :]
                        n, removed = n + len(joined), removed + sum(z - a for a, z in joined)
                    out.append((doc, text, n, removed))
                yield pd.DataFrame(out, columns=["doc_id", "text", "n_spans", "removed_words"])

        rows = rows.mapInPandas(run, "doc_id long, text string, n_spans int, removed_words int")
    return rows


def leaked_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, item_split, n_documents): which test items leaked, and how often; 0 for the others."""
    n = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        items.select("item_id", "suite", "item_split").distinct().join(n, "item_id", "left")
        .select("item_id", "suite", "item_split", F.coalesce("n", F.lit(0)).alias("n_documents"))
    )
