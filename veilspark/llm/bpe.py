"""Encoding a corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, spread

#: Where the vocabularies lie; the same path on the driver and on all executors.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The published pattern that splits text before the merges (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of up to so many code points are remembered, so many a worker; this changes nothing but speed.
CACHED_LENGTH, CACHED_PIECES = 48, 1 << 17


class PairTree:
    """A segment tree over byte positions. A leaf has the merge rank of the pair that begins at its position; a node has
    the least rank below it and, among equals, the leftmost position, as one integer rank * size + position."""

    __slots__ = ("none", "size", "tree")

    def __init__(self, ranks: list[int], none: int):
        self.size = 1 << max(0, (len(ranks) - 1).bit_length())
        self.none = none * self.size + self.size
        tree = [self.none] * (2 * self.size)
        for i, r in enumerate(ranks):
            if r < none:
                tree[self.size + i] = r * self.size + i
        for i in range(self.size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        self.tree = tree

    def update(self, i: int, rank: int | None) -> None:
        tree, at = self.tree, self.size + i
        tree[at] = self.none if rank is None else rank * self.size + i
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            least = a if a < b else b
            if tree[at] == least:
                return
            tree[at] = least
            at >>= 1

    def first(self) -> int:
        """The leftmost position of a pair with the least rank, or -1."""
        top = self.tree[1]
        return -1 if top >= self.none else top % self.size


class ByteBPE:
    """Ids of a text by the vocabulary's ranks: pieces of the published pattern, each merged by a PairTree.

    A merge is a constant number of point updates, of the pair itself and of its two live neighbours, so a piece of n bytes
    takes O(n log n) steps, whatever it consists of.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        n, ranks, longest = len(piece), self.ranks, self.longest
        if n == 1:
            return [ranks[piece]]
        none = 1 << 40
        end = list(range(1, n + 1))  # of the part that begins at a position
        before = list(range(-1, n - 1))  # the live position on its left
        tree = PairTree([ranks.get(piece[i : i + 2], none) for i in range(n - 1)] + [none], none)
        while (i := tree.first()) >= 0:
            j = end[i]
            k = end[i] = end[j]
            tree.update(j, None)
            tree.update(i, ranks.get(piece[i : end[k]]) if k < n and end[k] - i <= longest else None)
            if k < n:
                before[k] = i
            if (h := before[i]) >= 0:
                tree.update(h, ranks.get(piece[h:k]) if k - h <= longest else None)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """No ids for null and for an empty text. What looks like a special token is ordinary text."""
        if not text:
            return []
        known, out = self.known, []
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8"))
                if len(piece) <= CACHED_LENGTH:
                    if len(known) >= CACHED_PIECES:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


_loaded: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    """One a worker process."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def token_ids(spark: SparkSession, text: Column, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """array<int> of a text's ids; empty, never null, for a null and for an empty text."""
    ship_package(spark)
    path = os.path.join(folder, vocabulary)

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = tokenizer(path)
        for batch in batches:
            ids = [own.encode(x) for x in batch.to_pylist()]
            yield pa.array(ids, pa.list_(pa.int32()))

    return F.arrow_udf(encode, "array<int>").asNondeterministic()(text.cast("string"))


def token_count(spark: SparkSession, text: Column, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """The number of a text's ids; 0 for a null and for an empty text."""
    ship_package(spark)
    path = os.path.join(folder, vocabulary)

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = tokenizer(path)
        for batch in batches:
            yield pa.array([len(own.encode(x)) for x in batch.to_pylist()], pa.int64())

    return F.arrow_udf(count, "bigint").asNondeterministic()(text.cast("string"))


def encode_corpus(docs: DataFrame, text: str = "text", out: str = "ids", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """`docs` with the column `out` of token ids (replacing one of that name). Row by row, whole texts, without a shuffle; repeated rows are each encoded."""
    return spread(docs).withColumn(out, token_ids(docs.sparkSession, F.col(f"`{text}`"), folder, vocabulary))
