"""Byte-level BPE: exact merges in linear time, by backtracking from the longest matches.

Two neighbouring tokens are compatible if BPE, run over their joint bytes, would give just these two. A sequence of which
all neighbours are compatible is the one that the merges make, so the encoder walks from longest match to longest match and
steps back where a neighbour does not fit. Every position is given up at most once.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.batches import short_batches

CACHED_PIECES = 400_000
CACHED_PAIRS = 400_000


class Vocabulary(NamedTuple):
    """Tokens by rank, how each is made of two (itself twice if it isn't), and the longest token it begins with (-1: none)."""

    tokens: list[bytes]
    left: list[int]
    right: list[int]
    shorter: list[int]
    pattern: str


def _compatible(a: int, b: int, made: dict[tuple[int, int], int], left: list[int], right: list[int]) -> bool:
    """Whether no merge across the border of ``a`` and ``b`` comes before the merges that make the two."""
    before = len(left)
    while True:
        if made.get((a, b), before) < before:
            return False
        # Undo the later of the two merges next to the border; a merge across it must then come sooner than that one.
        if a > b:
            first, second = (a, right), (b, left)
        else:
            first, second = (b, left), (a, right)
        for token, part in (first, second):
            if part[token] != token:
                before = token + (part is left)
                if part is right:
                    a = right[token]
                else:
                    b = left[token]
                break
        else:
            return True


def load(path: str, pattern: str) -> Vocabulary:
    """Read a rank file (base64 token and rank per line; ranks 0, 1, 2, ...) on the driver; its size is that of the vocabulary."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    left, right, shorter = list(range(len(tokens))), list(range(len(tokens))), [-1] * len(tokens)
    for i, t in enumerate(tokens):
        shorter[i] = next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ranks), -1)
    made: dict[tuple[int, int], int] = {}
    for i, t in enumerate(tokens):
        a = shorter[i]
        while a >= 0:
            b = ranks.get(t[len(tokens[a]) :], len(tokens))
            if a < i and b < i and _compatible(a, b, made, left, right):
                made[a, b], left[i], right[i] = i, a, b
                break
            a = shorter[a]
    return Vocabulary(tokens, left, right, shorter, pattern)


class _Pieces(dict):
    """Packed ids by piece. Pieces that are tokens stay; of the others as many are kept as allowed, twice at most.

    When the newest are full they become the older ones, which are asked before a piece is merged again.
    """

    def __init__(self, tokens: list[bytes], merge: Callable[[bytes], list[int]], most: int):
        self.whole, self.older, self.merge, self.most = {}, {}, merge, most
        for i, t in enumerate(tokens):
            try:
                self.whole[t.decode()] = struct.pack("<I", i)
            except UnicodeDecodeError:  # no text has such a piece
                continue
        self.update(self.whole)

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = self.merge(piece.encode())
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) - len(self.whole) >= self.most:
                self.older = {k: v for k, v in self.items() if k not in self.whole}
                self.clear()
                self.update(self.whole)
            self[piece] = packed
        return packed


class Encoder:
    """Texts to token ids, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary, cached_pieces: int = CACHED_PIECES, cached_pairs: int = CACHED_PAIRS):
        self.tokens, self.left, self.right, self.shorter, pattern = vocabulary
        self.split = regex.compile(pattern).findall
        self.ranks = {t: i for i, t in enumerate(self.tokens)}
        self.sizes = [len(t) for t in self.tokens]
        self.made = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right, strict=True)) if a != i}
        self.machine = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            self.machine.add_word(t.decode("latin-1"), i)
        self.machine.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.pieces = _Pieces(self.tokens, self.merge, max(1, cached_pieces // 2))
        self.cached_pairs = cached_pairs

    def _fit(self, a: int, b: int) -> bool:
        pair = a * len(self.tokens) + b
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= self.cached_pairs:
                self.pairs.clear()
            known = self.pairs[pair] = _compatible(a, b, self.made, self.left, self.right)
        return known

    def merge(self, piece: bytes) -> list[int]:
        """The token ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, sizes = len(piece), self.sizes
        longest = [-1] * n
        for end, token in self.machine.iter(piece.decode("latin-1")):
            longest[end + 1 - sizes[token]] = token  # ends ascend, so the longest match of a start comes last
        usable, out, at, token = bytearray(b"\x01") * (n + 1), [], 0, longest[0]
        while at < n:
            end = at + sizes[token]
            if usable[end] and (not out or self._fit(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                usable[at] = 0
                token = out.pop()
                at -= sizes[token]
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))


_ready: dict[str, Encoder] = {}


def _encoder(name: str, vocabulary: tuple) -> Encoder:
    """The encoder of a Python worker, kept with what it remembers from task to task; another vocabulary replaces it."""
    if name not in _ready:
        _ready.clear()
        _ready[name] = Encoder(Vocabulary(*vocabulary))
    return _ready[name]


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``ids``: the token ids as little-endian unsigned 32-bit integers.

    A null text counts as empty and has no ids. Special tokens are ordinary text. A column named ``ids`` is replaced.
    The vocabulary is broadcast; its size is fixed by the file.
    """
    kept = [c for c in docs.columns if c != "ids"]
    shared, name = docs.sparkSession.sparkContext.broadcast(tuple(vocabulary)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, shared.value)
        for b in batches:
            ids = pa.array((encoder.encode(t.as_py() or "") for t in b.column(text)), pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), ids], names=[*kept, "ids"])

    return short_batches(docs).select(*kept).mapInArrow(run, docs.select(*kept, F.lit(b"").alias("ids")).schema)


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """The rows of ``docs`` with ``decoded``: the bytes that the ids stand for (null ids: empty)."""
    kept = [c for c in docs.columns if c != "decoded"]
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Vocabulary(*shared.value).tokens
        for b in batches:
            out = []
            for raw in b.column(ids):
                packed = raw.as_py() or b""
                out.append(b"".join([tokens[i] for i in memoryview(packed).cast("I")]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(out, pa.binary())], names=[*kept, "decoded"])

    return short_batches(docs).select(*kept).mapInArrow(run, docs.select(*kept, F.lit(b"").alias("decoded")).schema)


def encode_checked(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", check: str = "round_trip") -> DataFrame:
    """The rows of ``docs`` without their text, with the token ids and whether they decode to the text.

    Both happen in one pass, text by text, so neither texts nor decoded bytes go back to the JVM. A null text counts as empty.
    """
    kept = [c for c in docs.columns if c not in (text, ids, check)]
    shared, name = docs.sparkSession.sparkContext.broadcast(tuple(vocabulary)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, shared.value)
        tokens = encoder.tokens
        for b in batches:
            packed, same = [], []
            for t in b.column(text):
                t = t.as_py() or ""
                one = encoder.encode(t)
                packed.append(one)
                same.append(b"".join([tokens[i] for i in memoryview(one).cast("I")]) == t.encode())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(packed, pa.binary()), pa.array(same, pa.bool_())], names=[*kept, ids, check])

    columns = [F.col(f"`{c}`") for c in kept]
    schema = docs.select(*columns, F.lit(b"").alias(ids), F.lit(True).alias(check)).schema
    return short_batches(docs).select(*columns, F.col(f"`{text}`")).mapInArrow(run, schema)
