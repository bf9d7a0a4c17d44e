"""Token counts by byte-pair merging over a linked list with a heap of adjacent pairs.

``count = initial symbols - merges``; no identifier is emitted.  The vocabulary is a
``tokenizers`` JSON file of byte-level BPE; its special strings inside a text count as one
token each, which is that library's default.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted
again; an empty table gives an empty result; null ids are kept; further columns are ignored.
A piece of any length costs O(n log n); no text is cut.
"""

from __future__ import annotations

import functools
import json
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Pieces that a worker remembers; when it is full, it starts anew.
CACHE_PIECES = 600_000
_SHIFT = 17


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class HeapCounter:
    """Counts tokens of pieces with the merges of one vocabulary file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        self.byte_id = [vocab[c] for c in byte_alphabet()]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << _SHIFT | vocab[b]] = r
            self.made.append(vocab[a + b])
        special = sorted((t["content"] for t in data.get("added_tokens", []) if t.get("special")), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.marks = tuple(special)
        self.pieces = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def merges_left(self, piece: bytes) -> int:
        """Symbols that remain of ``piece`` when no adjacent pair has a rank."""
        ids = [self.byte_id[b] for b in piece]
        n = left = len(ids)
        rank, made = self.rank.get, self.made
        heap = [r << 32 | i for i in range(n - 1) if (r := rank(ids[i] << _SHIFT | ids[i + 1])) is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n or rank(ids[i] << _SHIFT | ids[j]) != r:
                continue  # one side has been merged away meanwhile
            ids[i], ids[j] = made[r], -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (r := rank(ids[i] << _SHIFT | ids[k])) is not None:
                    heappush(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank(ids[h] << _SHIFT | ids[i])) is not None:
                heappush(heap, r << 32 | h)
        return left

    def plain(self, text: str) -> int:
        found = self.pieces.findall(text)
        counts = list(map(self.known.get, found))
        if None in counts:
            known = self.known
            if len(known) > CACHE_PIECES:
                known.clear()
            for i, c in enumerate(counts):
                if c is None:
                    piece = found[i]
                    if (c := known.get(piece)) is None:
                        c = self.merges_left(piece.encode())
                        if len(piece) < 256:
                            known[piece] = c
                    counts[i] = c
        return sum(counts)

    def count(self, text: str) -> int:
        if self.special and any(m in text for m in self.marks):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.plain, parts))
        return self.plain(text)


@functools.lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> HeapCounter:
    return HeapCounter(path, pattern)


def count_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > ``limit``).

    One narrow map: no shuffle, and per worker a bounded memory of pieces.
    """

    def make():
        own = counter(path, pattern)
        return lambda texts: ([len(t.encode()) for t in texts], [own.count(t) for t in texts])

    made = common.map_texts(docs, text, make, [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return made.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return count_tokens(docs, path, public_tokenizers.PATTERN).select("doc_id", "n_bytes", "n_tokens", "over_limit")
