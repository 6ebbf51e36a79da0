"""Exact byte-pair encoding of whole corpora by a backtracking encoder.

A text is cut by the tokenizer's pattern. A piece that is a token is its own
encoding. Any other piece gets all token matches from one Aho-Corasick pass;
the encoder takes the longest match at each position and keeps it if its pair
with the token before is compatible, that is, if no merge across their border
would have come before the merges that made them. Otherwise it tries the next
shorter match, or steps back. A bit per position keeps it from coming twice to
a position that failed, so the work is linear in the text. Decoding copies
slices of one byte string by an offset table.

Defined cases: null and empty texts give an empty list; text that looks like a
special token is ordinary text; one row comes out for every row that goes in;
other columns, of whatever name, are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: how the tokenizer cuts a text into pieces before merging.
PIECES = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def read_ranks(data: bytes) -> list[bytes]:
    """Tokens by id from the lines of a .tiktoken file."""
    pairs = [line.split() for line in data.splitlines() if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Encoder:
    """Tables of one vocabulary, whose ids are in the order of the merges."""

    KEEP = 300_000  # pieces whose encodings are remembered; beyond it they are computed again

    def __init__(self, tokens: list[bytes]):
        import ahocorasick
        import regex

        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.pieces = regex.compile(PIECES)
        self._merges()
        self.shorter = [self._prefix(t) for t in tokens]
        self.matches = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.matches.add_word(t.decode("latin-1"), (i, len(t)))
        self.matches.make_automaton()
        self.known: dict[str, tuple[int, ...]] = {}
        self.blob = b"".join(tokens)
        self.offsets = [0]
        for t in tokens:
            self.offsets.append(self.offsets[-1] + len(t))

    def _prefix(self, token: bytes) -> int:
        for n in range(len(token) - 1, 0, -1):
            if (i := self.ids.get(token[:n])) is not None:
                return i
        return -1

    def _merges(self) -> None:
        """The two parts each token is merged from, and the token each pair of parts makes."""
        self.left, self.right = list(range(len(self.tokens))), list(range(len(self.tokens)))
        self.pair: dict[tuple[int, int], int] = {}
        for i, t in enumerate(self.tokens):
            for n in range(1, len(t)):
                a, b = self.ids.get(t[:n], i), self.ids.get(t[n:], i)
                if a < i and b < i and self.compatible(a, b):
                    self.left[i], self.right[i] = a, b
                    self.pair[a, b] = i
                    break

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: undo merges, the latest first, and look for an earlier one across the border."""
        pair, left, right = self.pair, self.left, self.right
        limit = len(self.tokens)
        while True:
            if pair.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a != limit:
                    continue
                limit, first = b + 1, b
                b = left[b]
                if b == first:
                    return True
            else:
                limit, last = b + 1, b
                b = left[b]
                if b != last:
                    continue
                limit, a = a, right[a]
                if a == limit:
                    return True

    def _backtrack(self, data: bytes) -> tuple[int, ...]:
        longest = [-1] * len(data)
        for end, (i, n) in self.matches.iter(data.decode("latin-1")):
            longest[end - n + 1] = i  # ends come in order, so the longest stays
        tokens, shorter = self.tokens, self.shorter
        open_at = [True] * (len(data) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(data):
            last = out[-1] if out else -1
            while token >= 0:
                end = at + len(tokens[token])
                if open_at[end] and (last < 0 or self.compatible(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < len(data) else -1
            else:
                open_at[at] = False
                token = out.pop()
                at -= len(tokens[token])
        return tuple(out)

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece."""
        if (got := self.known.get(text)) is None:
            data = text.encode("utf-8", "surrogatepass")
            one = self.ids.get(data)
            got = (one,) if one is not None else self._backtrack(data)
            if len(self.known) >= self.KEEP:
                self.known.clear()
            if len(text) <= 64:
                self.known[text] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text."""
        out: list[int] = []
        if text:
            known, grow = self.known, out.extend
            for p in self.pieces.findall(text):
                got = known.get(p)
                grow(self.piece(p) if got is None else got)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids."""
        blob, at = self.blob, self.offsets
        return b"".join([blob[at[i] : at[i + 1]] for i in ids]).decode("utf-8", "replace")


_MADE: dict[int, Encoder] = {}


def _encoder(data: bytes) -> Encoder:
    """The encoder of a vocabulary file, made once a worker."""
    import zlib

    key = zlib.crc32(data)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Encoder(read_ranks(data))
    return _MADE[key]


def encode_corpus(documents: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row. The vocabulary file (some 0.5 MB, a fixed size) is read by the driver and broadcast."""
    spark = documents.sparkSession
    with open(vocabulary, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    rows = documents.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(data.value)
        for b in batches:
            ids = pa.array([enc.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, ids array<int>")
