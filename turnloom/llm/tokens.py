"""Encoding of texts with a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's pattern. Each distinct piece is
merged once: its bytes form a doubly linked list, every adjacent pair that has
a rank goes onto a heap, the lowest rank (leftmost on ties) is merged, and heap
entries whose symbols have changed since are skipped. A piece of n bytes takes
O(n log n), so a single very long piece is no special case. Pieces met before
come from a bounded per-worker cache, which changes speed, never results.

Defined results: null and empty texts both give the empty list; strings that
look like special tokens are ordinary text; lone surrogates can't occur in Spark
strings. Texts are never cut.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern published with the byte_bpe_50k vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_PIECES = 200_000
CACHE_BYTES = 64


class BytePairEncoder:
    """Merge-rank encoder; ``ranks`` maps byte strings to ids in merge order."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.cut, self.cache = ranks, regex.compile(pattern), {}
        self.strings = {i: b for b, i in ranks.items()}

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, width = heapq.heappop(heap)
            left = symbol[i]
            if left is None or (j := after[i]) >= n:
                continue
            pair = left + symbol[j]
            if len(pair) != width or ranks.get(pair) != rank:
                continue  # stale: one of the two was merged since
            symbol[i], symbol[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(pair + symbol[k])) is not None:
                    heapq.heappush(heap, (r, i, width + len(symbol[k])))
            if (h := before[i]) >= 0 and (r := ranks.get(symbol[h] + pair)) is not None:
                heapq.heappush(heap, (r, h, width + len(symbol[h])))
        out, i = [], 0
        while i < n:
            out.append(ranks[symbol[i]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for piece in self.cut.findall(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8"))
                if len(piece) <= CACHE_BYTES:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8")


@lru_cache(maxsize=4)
def encoder(path: str = DEFAULT_RANKS, pattern: str = PATTERN) -> BytePairEncoder:
    """The encoder of a rank file (base64 bytes and id in each line), loaded once per worker process."""
    with open(path, "rb") as lines:
        return BytePairEncoder({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}, pattern)


def ids_column(path: str = DEFAULT_RANKS, pattern: str = PATTERN) -> object:
    """An Arrow UDF text -> array of token ids."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(path, pattern)
        for texts in batches:
            yield pd.Series([bpe.encode(t) for t in texts], dtype=object)

    return encode


def count_column(path: str = DEFAULT_RANKS, pattern: str = PATTERN) -> object:
    """An Arrow UDF text -> number of tokens; ids never leave the worker."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(path, pattern)
        for texts in batches:
            yield pd.Series([len(bpe.encode(t)) for t in texts], dtype="int64")

    return count


def encode_corpus(documents: DataFrame, *, id_column: str = "doc_id", text: str = "text", path: str = DEFAULT_RANKS) -> DataFrame:
    """``id_column``, ``ids`` of every row; no shuffle, one pass over two columns."""
    return documents.select(F.col(id_column), ids_column(path)(F.col(text)).alias("ids"))


def decode_corpus(encoded: DataFrame, *, id_column: str = "doc_id", ids: str = "ids", path: str = DEFAULT_RANKS) -> DataFrame:
    """``id_column``, ``text``: the vocabulary strings of ``ids`` put together again; null ids give the empty text."""

    @F.pandas_udf(T.StringType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(path)
        for lists in batches:
            yield pd.Series(["" if x is None else bpe.decode(list(x)) for x in lists], dtype=object)

    return encoded.select(F.col(id_column), decode(F.col(ids)).alias("text"))
